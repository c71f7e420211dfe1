"""Texts of public licences, without copyright lines, and the names of licences in notices."""

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_INCLUDED = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT = f"{_PERMISSION}, subject to the following conditions:\n\n{_INCLUDED}\n\n{_AS_IS}"
_MIT_0 = f"{_PERMISSION}.\n\n{_AS_IS}"
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"
_0BSD = f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}"
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = f"{_BSD_HEAD}\n\n{_BSD_AS_IS}"
_BSD_3 = f"{_BSD_HEAD}\n\n{_BSD_NAME}\n\n{_BSD_AS_IS}"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

#: Licence, its text, and titles that files put above it; a text without a title counts too.
_TITLED = [
    ("MIT", _MIT, ["MIT License", "MIT License (MIT)", "MIT", "This software is released under the MIT license:"]),
    ("MIT-0", _MIT_0, ["MIT No Attribution"]),
    ("ISC", _ISC, ["ISC License", "ISC License (ISC)", "ISC"]),
    ("0BSD", _0BSD, ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"]),
    ("BSD-2-Clause", _BSD_2, ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD License"]),
    ("BSD-3-Clause", _BSD_3, ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD License"]),
    ("Zlib", _ZLIB, ["zlib License"]),
    ("BSL-1.0", _BOOST, ["Boost Software License - Version 1.0 - August 17th, 2003"]),
    ("Unlicense", _UNLICENSE, []),
    ("WTFPL", _WTFPL, []),
]
#: (licence, entire text)
LICENCES = [
    (licence, f"{title}\n\n{text}".strip())
    for licence, text, titles in _TITLED
    for title in ["", *titles, *(f"The {t}" for t in titles)]
]

#: (licence, digest of the canonical form) of long texts; those with "terms" end at END OF TERMS AND CONDITIONS,
#: without the appendix.  Texts that several licences share go by the "only" one.
DIGESTS = [
    # Apache's own layout, then SPDX's; whole, with the owner filled in, terms
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Apache-2.0", "f92c423b6d6da66caa78abd6f49f73f5bc8715dca82e1a73f62d1e6eec41986c"),
    ("Apache-2.0", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("Apache-2.0", "e432e8e898c1e8c7b0aa4469211a67b133181d028edc178e68260a1bd607da6c"),
    ("Apache-2.0", "4ce775adc5eb2174f29d3108af3a9370e9699c3247713e6641d0ff8f355e79ac"),
    ("Apache-2.0", "ad487f4222d1dfb8a99d8a7dde283b408d93df794d074b3c92fe9efbe772be32"),
    # Debian's copies: whole, terms; then SPDX's: whole, terms
    ("GPL-1.0-only", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0-only", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0-only", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0-only", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-2.0-only", "0c64ee746791150d3c6210d29a2984d92afca30fa433f834ca884a3002b96384"),
    ("GPL-2.0-only", "a692f1cb3097cff45a40a996ead5dd80162238fb68187fdcd1a02eb56656e007"),
    ("GPL-3.0-only", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408"),
    ("GPL-3.0-only", "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545"),
    ("GPL-3.0-only", "719567f94c59314608007f0c51247c578702bae1919b3a2410889832649a72d8"),
    ("GPL-3.0-only", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("LGPL-2.0-only", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0-only", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1-only", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1-only", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    # whole
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC-BY-SA-4.0", "03d8a3b9c6db6790c3520a25812373d89c7f2a005ef01b18a0abcd015657a456"),
    ("GFDL-1.2-only", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3-only", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
]


def _names() -> list[tuple[str, str]]:
    """(licence, name): how notices call licences, built from titles, versions and short forms."""
    out = []

    def add(licence: str, *names: str) -> None:
        out.extend((licence, n) for n in (licence, *names))

    for licence, title in (("MIT", "MIT"), ("MIT-0", "MIT No Attribution"), ("ISC", "ISC"), ("0BSD", "BSD Zero Clause"), ("Zlib", "zlib"),
                           ("BSL-1.0", "Boost Software License 1.0"), ("Unlicense", "Unlicense"), ("WTFPL", "WTFPL")):
        add(licence, title, f"{title} License")
    add("BSL-1.0", "Boost Software License, Version 1.0")
    for n, word in ((2, "Simplified"), (3, "New")):
        add(f"BSD-{n}-Clause", f"BSD {n}-Clause License", f"{n}-Clause BSD License", f"{word} BSD License")
    for short, title, versions in (
        ("Apache", "Apache License", ["2.0"]),
        ("MPL", "Mozilla Public License", ["1.1", "2.0"]),
        ("EPL", "Eclipse Public License", ["1.0", "2.0"]),
    ):
        for v in versions:
            forms = [f"{title}, Version {v}", f"{title} {v}", f"{title} v{v}", f"{short} {v}", f"{short} {v} License"]
            add(f"{short}-{v}", *forms, *(f.replace(v, v.removesuffix(".0")) for f in forms[:3]))
    for short, title, versions in (
        ("GPL", "General Public License", ["1.0", "2.0", "3.0"]),
        ("LGPL", "Lesser General Public License", ["2.1", "3.0"]),
        ("AGPL", "Affero General Public License", ["3.0"]),
    ):
        for full in versions:
            v = full.removesuffix(".0")
            exact = [f"{g}{f}" for g in ("GNU ", "") for f in (f"{title}, version {v}", f"{title} v{full}", f"{title} v{v}",
                     f"{short} version {v}", f"{short} v{v}", f"{short}v{v}", f"{short}-{full}")]
            add(f"{short}-{full}-only", *exact, f"{exact[0]} only")
            add(f"{short}-{full}-or-later", *(f"{e} or later" for e in exact), f"{exact[0]}, or (at your option) any later version")
    kinds = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}
    for parts in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        title = "-".join(kinds[k] for k in parts.split("-"))
        for v in ("3.0", "4.0"):
            tail = f"{title} {v} {'International' if v == '4.0' else 'Unported'}"
            add(f"CC-{parts.upper()}-{v}", f"Creative Commons {tail} License", f"Creative Commons {tail}", f"Creative Commons {title} {v}")
    add("CC0-1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")
    return list(dict.fromkeys(out))


#: (licence, name) as they follow the opening of a notice.
NAMES = _names()
