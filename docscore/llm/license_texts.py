"""Licence templates: lines, standard headers, openings of long licences and whole short licences."""

from __future__ import annotations

import os

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at"
)
_APACHE_REST = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License."
)
_APACHE_URL = "http://www.apache.org/licenses/LICENSE-2.0"


def _gnu(name: str, version: str) -> list[str]:
    """The notice that GNU licences ask for, whole and by paragraph."""
    terms = f"the terms of the GNU {name} as published by the Free Software Foundation"
    grant = (
        f"This program is free software: you can redistribute it and/or modify it under {terms}, either version {version} of the License, or "
        "(at your option) any later version."
    )
    only = f"This program is free software; you can redistribute it and/or modify it under {terms}; version {version} of the License only."
    warranty = (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )
    copy = f"You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    return [grant, only, f"{grant} {warranty} {copy}", f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name}, version {version}."]


def _opening(name: str, version: str, day: str) -> str:
    return (
        f"GNU {name.upper()} Version {version}, {day} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed."
    )


# fixed values: licence ids with lines, headers, openings and whole texts
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", f"You may obtain a copy of the License at {_APACHE_URL}", "SPDX-License-Identifier: Apache-2.0",
        _APACHE_HEADER, f"{_APACHE_HEADER} {_APACHE_URL}", f"{_APACHE_HEADER} {_APACHE_URL} {_APACHE_REST}",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        _MIT_GRANT, f"{_MIT_GRANT} {_MIT_REST}",
    ],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0-only", *_gnu("General Public License", "2"), _opening("General Public License", "2", "June 1991")],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later", *_gnu("General Public License", "3"), _opening("General Public License", "3", "29 June 2007"),
    ],
    "LGPL-3.0": [
        "SPDX-License-Identifier: LGPL-3.0-or-later", *_gnu("Lesser General Public License", "3"), _opening("Lesser General Public License", "3", "29 June 2007"),
    ],
    "AGPL-3.0": [
        "SPDX-License-Identifier: AGPL-3.0-or-later", *_gnu("Affero General Public License", "3"), _opening("Affero General Public License", "3", "19 November 2007"),
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", f"{_BSD_OPENING} {_BSD_TWO} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", _BSD_OPENING, f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD}",
        f"{_BSD_OPENING} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}",
    ],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", _ISC],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": ["SPDX-License-Identifier: Unlicense", _UNLICENSE],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "Proprietary": ["All rights reserved."],
}


def with_files(folder: str, names: dict[str, str], templates: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The templates with the whole texts of licence files, ``names`` being ``{licence id: file name}`` in a folder of the driver."""
    out = {name: list(lines) for name, lines in (templates or TEMPLATES).items()}
    for licence, name in names.items():
        with open(os.path.join(folder, name), encoding="utf-8") as file:
            out.setdefault(licence, []).append(file.read())
    return out
