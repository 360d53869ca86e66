"""Texts and notices of common licenses, by version; parts of long ones stand for themselves."""

from __future__ import annotations

TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); "
    "you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at "
    "www.apache.org/licenses/LICENSE-2.0. Unless required by "
    "applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an AS IS BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-grant": "Grant of Copyright License. Subject to the terms and conditions "
    "of this License, each Contributor hereby grants to You a "
    "perpetual, worldwide, non-exclusive, no-charge, royalty-free, "
    "irrevocable copyright license to reproduce, prepare Derivative "
    "Works of, publicly display, publicly perform, sublicense, and "
    "distribute the Work and such Derivative Works in Source or "
    "Object form.",
    "Apache-2.0-patents": "Grant of Patent License. Subject to the terms and conditions of "
    "this License, each Contributor hereby grants to You a perpetual, "
    "worldwide, non-exclusive, no-charge, royalty-free, irrevocable "
    "(except as stated in this section) patent license to make, have "
    "made, use, offer to sell, sell, import, and otherwise transfer "
    "the Work",
    "Apache-2.0-warranty": "Disclaimer of Warranty. Unless required by applicable law or "
    "agreed to in writing, Licensor provides the Work (and each "
    "Contributor provides its Contributions) on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied, including, without limitation, any warranties or "
    "conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or "
    "FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person "
    "obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without "
    "restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission "
    "notice shall be included in all copies or substantial portions "
    "of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person "
    "obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without "
    "restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or "
    "sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, "
    "version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, "
    "version 2.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or "
    "modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of "
    "the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or "
    "modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 2 of "
    "the License, or (at your option) any later version.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or "
    "modify it under the terms of the GNU General Public License "
    "version 2 as published by the Free Software Foundation.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or "
    "modify it under the terms of the GNU General Public License "
    "version 3 as published by the Free Software Foundation.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or "
    "modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or "
    "modify it under the terms of the GNU Lesser General Public "
    "License as published by the Free Software Foundation; either "
    "version 2.1 of the License, or (at your option) any later "
    "version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or "
    "modify it under the terms of the GNU Affero General Public "
    "License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "General Public License for more details.",
    "LGPL-warranty": "This library is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "Lesser General Public License for more details.",
    "AGPL-warranty": "This program is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "Affero General Public License for more details.",
    "GPL-2.0-preamble": "The licenses for most software are designed to take away your "
    "freedom to share and change it. By contrast, the GNU General "
    "Public License is intended to guarantee your freedom to share "
    "and change free software, to make sure the software is free for "
    "all its users.",
    "GPL-3.0-preamble": "The GNU General Public License is a free, copyleft license for "
    "software and other kinds of works. The licenses for most "
    "software and other practical works are designed to take away "
    "your freedom to share and change the works. By contrast, the GNU "
    "General Public License is intended to guarantee your freedom to "
    "share and change all versions of a program, to make sure it "
    "remains free software for all its users.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or "
    "without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or "
    "without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. Neither the name of "
    "the copyright holder nor the names of its contributors may be "
    "used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "BSD": "Redistribution and use in source and binary forms, with or "
    "without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
    "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "ISC": "Permission to use, copy, modify, and/or distribute this software "
    "for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice "
    "appear in all copies.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla "
    "Public License, version 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla "
    "Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/.",
    "EPL-1.0": "This program and the accompanying materials are made available "
    "under the terms of the Eclipse Public License v1.0 which "
    "accompanies this distribution",
    "EPL-2.0": "This program and the accompanying materials are made available "
    "under the terms of the Eclipse Public License 2.0 which is "
    "available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or "
    "organization obtaining a copy of the software and accompanying "
    "documentation covered by this license (the Software) to use, "
    "reproduce, display, distribute, execute, and transmit the "
    "Software, and to prepare derivative works of the Software, and "
    "to permit third-parties to whom the Software is furnished to do "
    "so",
    "Zlib": "This software is provided as-is, without any express or implied "
    "warranty. In no event will the authors be held liable for any "
    "damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution- "
    "ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 "
    "International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution- "
    "NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution- "
    "NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution- "
    "NonCommercial-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all "
    "copyright and related or neighboring rights to this work.",
    "Unlicense-line": "This is free and unencumbered software released into the public "
    "domain.",
    "Unlicense": "This is free and unencumbered software released into the public "
    "domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or "
    "as a compiled binary, for any purpose, commercial or non- "
    "commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or "
    "modified copies of this license document, and changing it is "
    "allowed as long as the name is changed.",
}
