"""What licences say: names by which they are referred to, passages to learn from, passages that confirm.

The passages are quoted from the licences as published and are fixed values.  No passage that confirms a family is
among those it is learned from.
"""

from __future__ import annotations

#: Names of each family; references are made from them by rule.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0"),
    "mit": ("MIT License", "MIT license", "the MIT license terms", "MIT-style license"),
    "isc": ("ISC License", "ISC license terms"),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"),
    "bsd-3-clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "bsd": ("BSD license", "BSD-style license", "Berkeley license"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL version 2"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL version 3"),
    "gpl": ("GNU General Public License", "GNU GPL", "the GPL license"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "the LGPL license"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "epl-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"),
    "cddl-1.0": ("Common Development and Distribution License, version 1.0", "CDDL 1.0", "CDDL-1.0"),
    "artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "zlib": ("zlib License", "zlib/libpng License"),
    "bsl-1.0": ("Boost Software License, version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "unlicense": ("The Unlicense", "Unlicense license"),
    "wtfpl": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "cc0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero", "CC0-1.0"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "CC-BY-SA 3.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0"),
    "cc-by-nc-sa": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "CC-BY-NC-SA-4.0"),
    "cc-by-nd": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-ND 3.0", "CC-BY-ND-4.0"),
    "proprietary": ("all rights reserved",),
}

#: Families that say no version; a stretch of one beside a version is part of it.
UNVERSIONED = {
    "gpl": ("gpl-2.0", "gpl-3.0", "lgpl", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"),
    "lgpl": ("lgpl-2.1", "lgpl-3.0"),
    "bsd": ("bsd-2-clause", "bsd-3-clause"),
    "gpl-3.0": ("lgpl-3.0", "agpl-3.0"),
}


def said_by(family: str, words: list[str]) -> str:
    """The family that words out of a notice tell by themselves: GNU licences share most of what they say."""
    if family not in UNVERSIONED["gpl"]:
        return family
    digits = any(c.isdigit() for w in words for c in w)
    if "affero" in words or any("agpl" in w for w in words):
        return "agpl-3.0"
    if "lesser" in words or any("lgpl" in w for w in words):
        return family if digits and family.startswith("lgpl") else "lgpl"
    if digits and family in UNVERSIONED["gpl-3.0"]:
        return "gpl-3.0"
    return family if digits and family != "lgpl" else "gpl"

LEARN: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES",
    ),
    "bsd-3-clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",),
    "bsd-2-clause": ("The views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies",),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is free software under the terms of the GNU General Public License, either version 3 of the License or any later version.",
    ),
    "gpl": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software",
    ),
    "lgpl": (
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Each Contributor represents that the Contributor believes its Contributions are its original creation(s) or it has sufficient rights to grant the rights to its Contributions conveyed by this License.",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",
    ),
    "cddl-1.0": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",),
    "artistic-2.0": ("This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed. The intent is that the Copyright Holder maintains some artistic control over the development of that Package",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "bsl-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary",),
    "wtfpl": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "cc0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "cc-by": ("You are free to share and adapt the material for any purpose, even commercially, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",),
    "cc-by-sa": ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",),
    "cc-by-nc": ("You may not use the material for commercial purposes.",),
    "cc-by-nc-sa": ("You may not use the material for commercial purposes, and if you remix it you must distribute your contributions under the same license; share alike and non commercial.",),
    "cc-by-nd": ("If you remix, transform, or build upon the material, you may not distribute the modified material.",),
    "proprietary": (
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is the confidential and proprietary information of the company and may not be disclosed or used except under a license agreement.",
        "No part of this publication may be reproduced, stored in a retrieval system, or transmitted without the prior written permission of the publisher.",
    ),
}

CONFIRM: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "See the License for the specific language governing permissions and limitations under the License.",
        "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "mit": (
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ),
    "isc": ("IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION",),
    "bsd": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT",
    ),
    "bsd-3-clause": ("may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd-2-clause": ("those of the authors and should not be interpreted as representing official policies, either expressed or implied, of the project",),
    "gpl-2.0": ("either version 2 of the License, or (at your option) any later version.", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston"),
    "gpl-3.0": ("either version 3 of the License, or (at your option) any later version.",),
    "gpl": ("You should have received a copy of the GNU General Public License along with this program", "When we speak of free software, we are referring to freedom, not price."),
    "lgpl": ("You should have received a copy of the GNU Lesser General Public License along with this library",),
    "lgpl-2.1": ("either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-3.0": ("Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "agpl-3.0": ("if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source", "Affero General Public License as published by the Free Software Foundation, either version 3"),
    "mpl-2.0": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "epl-2.0": ("ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",),
    "cddl-1.0": ("When distributing Covered Code, include this CDDL HEADER in each file and include the License file",),
    "artistic-2.0": ("You are permitted to use the Standard Version and create and use Modified Versions for any purpose without restriction, provided that you do not Distribute the Modified Version.",),
    "zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    "bsl-1.0": ("unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",),
    "unlicense": ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",),
    "wtfpl": ("You just DO WHAT THE FUCK YOU WANT TO.",),
    "cc0-1.0": ("You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission. Dedicated to the public domain",),
    "cc-by": ("Attribution: You must give appropriate credit, provide a link to the license, and indicate if changes were made",),
    "cc-by-sa": ("ShareAlike: If you remix, transform, or build upon the material, you must distribute your contributions under the same license",),
    "cc-by-nc": ("NonCommercial: You may not use the material for commercial purposes",),
    "cc-by-nc-sa": ("Attribution NonCommercial ShareAlike",),
    "cc-by-nd": ("NoDerivatives: If you remix, transform, or build upon the material, you may not distribute the modified material",),
    "proprietary": ("Unauthorized copying of this file is strictly prohibited.",),
}

#: References are learned with these words around a name, and tested with the others.
SAID = ("Licensed under the {}.", "This work is licensed under the {}", "SPDX-License-Identifier: {}", "released under the terms of the {}", "See the {} for details", "under {}.", "{}", "license: {}", "Dual licensed under {}")
#: The same for reserved rights, which are no licence.
SAID_RESERVED = ("{}", "{}.", "Copyright {}.", "2024 {}")
SAID_ELSEWHERE = ("Distributed under {}.", "available under the {} licence", "It may be used under {}", "You can redistribute it under the {}", "published under {}", "Released under the {}.")
