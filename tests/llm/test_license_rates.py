"""Rates of the license scan on notices that no table of the module holds. Written before the first run on them; they set no
parameter, and the module is not to be tuned on them."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from arborlake.llm import op6_license_scans  # noqa: E402

NOTICES = {
    "agpl": [
        "AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only", "The server is free software under the GNU AGPL v3.", "License: GNU Affero General Public License v3.0", "Copyright 2019 Ana Ruiz. Licensed under AGPLv3.",
        "it under the terms of the GNU Affero General Public License as", "This project is licensed under the terms of the GNU Affero General Public License v3.0.",
    ],
    "apache": [
        "Apache License, Version 2.0", "Licensed under Apache 2.0", "License: Apache-2.0", "This code is made available under the Apache 2.0 license.", "The library is distributed under the Apache License 2.0, see LICENSE for details.",
        "you may not use this file except in compliance with the License.", "distributed under the License is distributed on an \"AS IS\" BASIS,", "Apache License",
    ],
    "bsd": [
        "BSD 3-Clause License", "Licensed under the New BSD License.", "SPDX-License-Identifier: BSD-2-Clause", "License: BSD", "This module is available under the Simplified BSD License.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.", "modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": [
        "CC BY 4.0", "CC-BY-4.0", "Attribution 4.0 International", "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License, which permits unrestricted use.",
        "Photo by R. Meyer, licensed under CC BY 2.0", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 license.", "Available under a Creative Commons Attribution license.",
    ],
    "cc-by-nc": [
        "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Attribution-NonCommercial 4.0 International", "These slides are shared under CC BY-NC 3.0.", "The dataset is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0", "Audio files are available under a Creative Commons Attribution-NonCommercial license.",
    ],
    "cc-by-sa": [
        "CC BY-SA 3.0", "Attribution-ShareAlike 4.0 International", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.", "This page is licensed under CC BY-SA.",
        "SPDX-License-Identifier: CC-BY-SA-4.0", "Map data licensed under CC-BY-SA 2.0", "Content is released under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ],
    "cc0": [
        "CC0", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, Jo Park has waived all copyright and related rights to Small Words.", "Dedicated to the public domain under CC0.",
        "This file is available under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "License: CC0-1.0",
    ],
    "gpl": [
        "GNU General Public License v2", "GPLv3", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL.", "License: GPL-3.0", "This module is part of Tarn and is released under the GNU General Public License v3 or later.",
        "You should have received a copy of the GNU General Public License along with this program.", "the Free Software Foundation, either version 3 of the License, or",
    ],
    "isc": [
        "ISC License", "ISC", "SPDX-License-Identifier: ISC", "License: ISC", "Licensed under the ISC license.", "This package is distributed under the terms of the ISC License, see LICENSE.",
        "copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the LGPL.", "GNU Lesser General Public License v3.0", "The bindings are available under the GNU LGPL version 2.1.", "License: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "mit": [
        "MIT License", "The MIT License (MIT)", "Licensed under the MIT license", "License: MIT", "MIT", "This project is licensed under the MIT License - see the LICENSE file for details.", "Copyright (c) 2020 Li Wen. Available under the MIT license.",
        "of this software and associated documentation files (the \"Software\"), to deal", "copies or substantial portions of the Software.",
    ],
    "mpl": [
        "Mozilla Public License Version 2.0", "MPL-2.0", "License: MPL-2.0", "Licensed under the MPL 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright 2021 Northwind Ltd. All rights reserved.", "CONFIDENTIAL AND PROPRIETARY. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This source code is proprietary and may not be copied or disclosed.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior permission of the publisher.", "Proprietary software. Do not distribute.",
    ],
    "unlicense": [
        "The Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "License: Unlicense", "Released under the Unlicense.", "This code is in the public domain (Unlicense).",
    ],
}

OTHERS = [
    "European Union Public Licence 1.2", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: NCSA", "License: Zlib", "Licensed under the zlib license.", "Boost Software License 1.0", "Licensed under the Python Software Foundation License.",
    "License: PSF-2.0", "Eclipse Public License - v 1.0", "CDDL-1.0", "License: CDDL", "Released under the Ruby license.", "Licensed under the PHP License 3.01.", "SPDX-License-Identifier: OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "Licensed under the Artistic License.", "This font software is licensed under the Ubuntu Font Licence.", "The GNU Free Documentation License, Version 1.3", "Licensed under the GNU Free Documentation License.", "SPDX-License-Identifier: GFDL-1.3",
    "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.", "Open Data Commons Attribution License v1.0",
    "Data is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/.", "Contains public sector information licensed under the Open Government Licence v3.0.", "SPDX-License-Identifier: WTFPL",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "Licensed under the Beerware license.", "License: SSPL-1.0", "Business Source License 1.1", "Licensed under the Commons Clause.", "SPDX-License-Identifier: PostgreSQL", "Licensed under the Sleepycat license.",
    "IBM Public License Version 1.0", "Licensed under the Apple Public Source License 2.0.", "SPDX-License-Identifier: MS-PL", "Microsoft Reciprocal License (MS-RL)", "The Universal Permissive License (UPL), Version 1.0",
    "Licensed under the Educational Community License, Version 2.0.", "Licensed under the Blue Oak Model License.", "Open LDAP Public License, version 2.8", "X11 fonts are covered by the Bitstream Vera license.", "Licensed under the Mulan Permissive Software License.",
    "Licensed under the Vovida Software License.", "Q Public License", "Sun Industry Standards Source License", "Nokia Open Source License", "License: Proprietary fonts may not be embedded, ask the foundry",
    "The MIT campus lies along the Charles River.", "She studied physics at MIT before she moved to Geneva.", "Apache tribes lived in the southwest for centuries.", "The Apache web server answered on port 80.", "Is the GPL compatible with the license of our parser?",
    "We compared the MIT, BSD and GPL licenses in chapter four.", "The foundation granted the school a permission to rebuild the gym.", "He was granted a licence to sell spirits in 1874.", "Drivers must carry a license at all times.",
    "The general terms and conditions apply to all orders.", "Copyright infringement is a civil matter in most countries.", "The court held that the copyright had expired.", "The warranty covers parts but not labour.", "Press F1 to read the documentation of the installer.",
    "All seats are reserved for members of the club.", "The table was reserved for eight people.", "Distribution of the leaflets began in May.", "The commons were fenced off by the lords.", "The House of Commons voted on the bill.", "Mozilla released a new browser on Tuesday.",
    "FreeBSD and NetBSD share much of their code.", "The BSD talk starts at noon.", "GNU Emacs has a tutorial for beginners.", "He wears a GNU shirt to every meeting.", "A wildebeest is also called a gnu.", "In compliance with the rules, the match was stopped.",
    "The binary forms of both numbers are equal.", "This program is free of charge for students.", "You can obtain a copy of the form at the town hall.", "The software is sold without a manual.", "The domain was registered in 1998.", "Public domain films are shown on Fridays.",
    "The word licence is a noun in British spelling.", "They waived the fee for families.", "To the extent possible, the guests should arrive on foot.", "The notice appeared in all newspapers.", "Permission slips are due on Monday.", "The author has hereby declared war on adverbs.",
    "Redistribution of wealth was the theme of the debate.", "Universal suffrage came in 1918.", "The modification of the engine took three weeks.", "Confidential letters are kept in the safe.", "Smoking is strictly prohibited in the stables.", "The attribution of the painting is disputed.",
    "A disclaimer at the end of the film named the actors.", "Unauthorized visitors will be turned away.", "International law does not cover the case.", "The ISC conference was held in Frankfurt.", "Her dogs are licensed and vaccinated.", "Version 2.0 of the map shows the new road.",
]


def test_rates(table):
    notices = [(t, f) for f, texts in NOTICES.items() for t in texts]
    texts = [t for t, _ in notices] + OTHERS
    assert len(notices) >= 98 and len(OTHERS) >= 98
    got = [r.families for r in sorted(op6_license_scans.license_scan(table(texts)).collect(), key=lambda r: r.doc_id)]
    missed = [(t, f, g) for (t, f), g in zip(notices, got) if g != [f]]
    wrong = [(t, g) for t, g in zip(OTHERS, got[len(notices) :]) if g]
    print(f"recall {1 - len(missed) / len(notices):.3f} of {len(notices)}, false confirmations {len(wrong)} of {len(OTHERS)}", missed, wrong, sep="\n")
    assert len(missed) <= 0.2 * len(notices) and len(wrong) <= 0.02 * len(OTHERS)
