"""Titles, usual notices, standard headers and whole texts of licences, as templates beside the one-line notices.

Whole texts are the files of ``licenses/``, read on the driver; those of MIT and BSD-3-Clause stand here.
"""

from __future__ import annotations

from pathlib import Path

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_BSD_REST = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _gnu(name: str, version: str, kind: str = "") -> list[str]:
    """Grant, whole header and title of a GNU licence; ``kind`` as in its name."""
    what = "library" if kind and version != "3" else "program"
    grant = (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
             f"License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
             "later version.")
    rest = (f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
            f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. "
            f"You should have received a copy of the GNU {kind}General Public License along with this {what}.")
    return [grant, f"{grant} {rest}", f"GNU {kind}General Public License Version {version}, {name}"]


TEXTS: dict[str, list[str]] = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0",
                   _APACHE, f"{_APACHE}\n{_APACHE_REST}"],
    "BSD-3-Clause": ["BSD 3-Clause License", _BSD, f"{_BSD}\n{_BSD_REST}"],
    "GPL-2.0": _gnu("June 1991", "2"),
    "GPL-3.0": _gnu("29 June 2007", "3"),
    "LGPL-2.1": _gnu("February 1999", "2.1", "Lesser "),
    "LGPL-3.0": _gnu("29 June 2007", "3", "Lesser "),
    "MIT": ["The MIT License", "This software is released under the MIT License, see the file LICENSE for details.",
            _MIT, f"MIT License {_MIT}", f"{_MIT}\n{_MIT_REST}"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", _MPL],
}
for _file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    TEXTS.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))
