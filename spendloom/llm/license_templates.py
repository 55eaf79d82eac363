"""Licence notices and permission texts to scan for. Fixed values: (id, family, text).

A licence whose wording another one shares by four fifths stands here beside it: a scan names
the nearest of the texts it knows.
"""


def _gnu(name: str, version: str, subject: str = "program") -> str:
    return (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        f"later version. This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)

TEMPLATES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-notice-licensed", "MIT", "Licensed under the MIT License."),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("gpl-3.0-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "mit",
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("bsd-2-clause", "BSD-2-Clause", _BSD_2),
    (
        "mpl-2.0-header",
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("all-rights-reserved", "Proprietary", "All rights reserved."),
    # Siblings of the above.
    ("gpl-2.0-header", "GPL-2.0", _gnu(_GNU["GPL"], "2")),
    ("lgpl-2.0-header", "LGPL-2.0", _gnu("GNU Library General Public License", "2", "library")),
    ("lgpl-2.1-header", "LGPL-2.1", _gnu(_GNU["LGPL"], "2.1", "library")),
    ("lgpl-2.1-header-program", "LGPL-2.1", _gnu(_GNU["LGPL"], "2.1")),
    ("lgpl-3.0-header", "LGPL-3.0", _gnu(_GNU["LGPL"], "3")),
    ("lgpl-3.0-header-library", "LGPL-3.0", _gnu(_GNU["LGPL"], "3", "library")),
    ("agpl-3.0-header", "AGPL-3.0", _gnu(_GNU["AGPL"], "3")),
    *((f"{k.lower()}-{v}-notice", f"{k}-{v}", f"This work is licensed under the {_GNU[k]}, version {v.removesuffix('.0')}.") for k, v in (("GPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))),
    ("bsd-3-clause", "BSD-3-Clause", f"{_BSD_2} 3. {_ENDORSE}"),
    (
        "bsd-4-clause",
        "BSD-4-Clause",
        f"{_BSD_2} 3. All advertising materials mentioning features or use of this software must display the following "
        f"acknowledgement: This product includes software developed by the copyright holder. 4. {_ENDORSE}",
    ),
    *((f"cc-{k.lower()}-4.0-notice-international", f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items() if k != "BY-SA"),
    *((f"cc-{k.lower()}-3.0-notice-unported", f"CC-{k}-3.0", f"This work is licensed under a Creative Commons {'Attribution-NonCommercial-NoDerivs' if k == 'BY-NC-ND' else 'Attribution-NoDerivs' if k == 'BY-ND' else v} 3.0 Unported License.") for k, v in _CC.items()),
    *((f"cc-{k.lower()}-4.0-notice-short", f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
]
