"""Texts and notices of common public licenses."""

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str, later: bool) -> list[str]:
    """The notice that the license asks for, and short forms."""
    either = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    program = "library" if "Lesser" in name else "program"
    return [
        f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {either}. "
        f"This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details.",
        f"under the terms of the GNU {name} as published by the Free Software Foundation, {either}",
    ]


def _named(name: str, version: str) -> list[str]:
    return [f"This work is licensed under the GNU {name}, version {version}", f"licensed under the GNU {name} v{version}", f"GNU {name} Version {version}"]


def _spdx(*ids: str) -> list[str]:
    return [f"SPDX-License-Identifier: {i}" for i in ids]


def _creative(code: str, name: str) -> list[str]:
    return [f"Licensed under CC {code} 4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License", f"creativecommons.org/licenses/{code.lower()}/4.0", *_spdx(f"CC-{code}-4.0")]


# Wording of the licenses.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004", *_spdx("Apache-2.0"),
    ],
    "MIT": [
        "Released under the MIT License", "Licensed under the MIT License", "Distributed under the MIT License", _MIT,
        f"{_MIT} (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        f"furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
        *_spdx("MIT"),
    ],
    "BSD": [_BSD],
    "BSD-2-Clause": [f"{_BSD}: {_BSD_TWO} {_BSD_END}", f"{_BSD}: {_BSD_TWO}", *_spdx("BSD-2-Clause")],
    "BSD-3-Clause": [f"{_BSD}: {_BSD_TWO} {_BSD_THIRD} {_BSD_END}", f"{_BSD}: {_BSD_TWO} {_BSD_THIRD}", *_spdx("BSD-3-Clause")],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        *_spdx("ISC"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0", *_spdx("MPL-2.0"),
    ],
    "GPL-2.0": [*_named("General Public License", "2"), *_gnu("General Public License", "2", False), *_spdx("GPL-2.0-only", "GPL-2.0")],
    "GPL-2.0-or-later": [*_gnu("General Public License", "2", True), *_spdx("GPL-2.0-or-later")],
    "GPL-3.0": [*_named("General Public License", "3"), *_gnu("General Public License", "3", False), *_spdx("GPL-3.0-only", "GPL-3.0")],
    "GPL-3.0-or-later": [*_gnu("General Public License", "3", True), *_spdx("GPL-3.0-or-later")],
    "LGPL-2.1": [*_named("Lesser General Public License", "2.1"), *_gnu("Lesser General Public License", "2.1", False), *_spdx("LGPL-2.1-only")],
    "LGPL-2.1-or-later": [*_gnu("Lesser General Public License", "2.1", True), *_spdx("LGPL-2.1-or-later")],
    "LGPL-3.0": [*_named("Lesser General Public License", "3"), *_gnu("Lesser General Public License", "3", False), *_spdx("LGPL-3.0-only")],
    "LGPL-3.0-or-later": [*_gnu("Lesser General Public License", "3", True), *_spdx("LGPL-3.0-or-later")],
    "AGPL-3.0": [*_named("Affero General Public License", "3"), *_gnu("Affero General Public License", "3", False), *_spdx("AGPL-3.0-only")],
    "AGPL-3.0-or-later": [*_gnu("Affero General Public License", "3", True), *_spdx("AGPL-3.0-or-later")],
    "CC-BY-4.0": _creative("BY", "Attribution"),
    "CC-BY-SA-4.0": _creative("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "creativecommons.org/publicdomain/zero/1.0", *_spdx("CC0-1.0")],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain", *_spdx("Unlicense"),
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", *_spdx("BSL-1.0")],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", *_spdx("EPL-2.0")],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution.",
        *_spdx("Zlib"),
    ],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
}
