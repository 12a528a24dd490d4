"""License scans: a trained paragraph classifier in DataFrame functions, confirmed by templates.

Paragraphs are lines. Lines with a word that begins with one of CUES are candidates, and only they are
looked at: every eight words in a row of every notice have such a word, but a shorter piece of one
may have none. A line of one word has no word pair and is never confirmed. Candidates are scored
by a sparse logistic regression over their distinct word 1-, 2- and 3-grams, with one class for each
licence family and one for unknown. Templates are notices, and the names and identifiers of licences
in short sentences. The probabilities are calibrated by a temperature, and a family
stands only if its probability reaches a threshold; both are taken from notices that the model has not
seen (HELD, and HELD_OTHERS, licences of families that are not in the table): the threshold is the
least, not below LEAST_PROB, at which none of HELD_OTHERS is both predicted and confirmed. A prediction is confirmed if the paragraph shares
enough word pairs with a template of that family, has a word that names the family where the template
has one (NAMES), and no word that names another variant (VARIANTS); otherwise it is unknown.

Equal paragraphs are scored once: paragraphs are grouped by their text before they are cut into
n-grams, and verdicts are joined back by the paragraph's digest, so a licence line on a third of all
documents costs one score. Weights and templates are tables of fixed size, fitted on the driver to
the templates below; weights are whole numbers (millionths), so sums do not depend on their order.

Defined cases: a null or empty text has no paragraphs; repeated rows return as often as they came,
each with its own paragraphs; of equal scores the first family in the order of names wins; texts
may be of any length and are read whole; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_checked, table

#: Licence notices by family.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You may redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU GPL version 2.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You may redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this work may be reproduced without the prior written permission of the copyright holder.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
        "Copyright the authors. All rights reserved.",
        "This source code is the confidential property of the company and may not be copied or disclosed without its written consent.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense.",
    ],
}

#: Names of licences, and their identifiers in package files, by family.
TITLES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License v3.0", "Affero General Public License version 3", "GNU AGPL", "GNU AGPL version 3", "AGPL", "AGPLv3"],
    "apache": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0", "Apache Software License", "Apache-2.0 License"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "Modified BSD License", "New BSD License", "Simplified BSD License", "BSD"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC BY 3.0", "CC BY 2.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Attribution 4.0 International"],
    "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Attribution-NonCommercial 4.0 International"],
    "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA 2.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Attribution-ShareAlike 4.0 International"],
    "cc0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 License"],
    "gpl": ["GNU General Public License", "GNU General Public License v2", "GNU General Public License v3.0", "GNU General Public License, version 2", "GNU GPL", "GNU GPL version 3", "GPL", "GPLv2", "GPLv3"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "GNU LGPL version 3", "LGPL", "LGPLv2.1", "LGPLv3"],
    "mit": ["MIT License", "MIT License (MIT)", "MIT/Expat License", "MIT"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License Version 1.1", "Mozilla Public License, v. 2.0", "MPL", "MPL 2.0"],
    "unlicense": ["Unlicense"],
}
IDS = {
    "agpl": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "apache": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-3.0", "CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"],
    "cc-by-sa": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"], "cc0": ["CC0-1.0"], "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "isc": ["ISC"],
    "lgpl": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "mit": ["MIT"], "mpl": ["MPL-1.1", "MPL-2.0"], "unlicense": ["Unlicense"],
}
#: Sentences around a name and around an identifier; the first ones are also templates.
TITLE_FRAMES = ["{}", "Licensed under the {}", "The {}", "Released under the {}.", "Distributed under the terms of the {}.", "Available under {}", "This project is licensed under the {}, see the file LICENSE."]
ID_FRAMES = ["{}", "SPDX-License-Identifier: {}", "License: {}"]
TITLE_TEMPLATES = 2

#: Paragraphs that name licences without stating one, and prose.
NEGATIVES = [
    "He lost his driver's license and had to apply for a new one at the office.",
    "The license plate of the car was covered in mud.",
    "A fishing licence is required in most states before the season begins.",
    "The minister defended the licensing of new bars in the old town.",
    "Poetic license allows the author to change the order of events.",
    "Copyright law differs between countries and changes with every treaty.",
    "The museum asked for permission to show the paintings in spring.",
    "The warranty of the washing machine ended a week before it broke.",
    "The software is described in the next chapter together with its source code.",
    "They walked along the river to the village and talked about the harvest.",
    "Which license should we choose for the project, someone asked in the meeting.",
    "The general public was admitted free of charge on Sundays.",
    "An apache helicopter landed in the field next to the school.",
    "Students of the university distributed copies of the paper in the street.",
    "The terms of the contract were published by the foundation last year.",
    "Version 2.0 of the game was released with better graphics.",
]
#: Other licences, which the model learns as unknown.
OTHERS = [
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "This program is made available under the terms of the Common Development and Distribution License.",
    "Released under the terms of the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Microsoft Public License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License.",
    "SPDX-License-Identifier: CC-BY-NC-ND-3.0",
    "Licensed under the Business Source License 1.1.",
    "This database is made available under the Open Database License.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it.",
    "Licensed under the Academic Free License version 3.0.",
    "Released under the WTFPL, version 2.",
    "of this software and associated documentation files",  # several licences have it
]
#: Names of other licences: the model learns every second one as unknown, and its threshold is taken from the rest.
OTHER_TITLES = [
    "Academic Free License", "Adaptive Public License", "Apple Public Source License", "Artistic License", "Attribution Assurance License", "Boost Software License", "Business Source License", "CeCILL License", "Common Development and Distribution License",
    "Common Public Attribution License", "Computer Associates Trusted Open Source License", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CUA Office Public License", "Eclipse Public License", "Educational Community License",
    "Eiffel Forum License", "Elastic License", "European Union Public Licence", "Fair License", "Free Art License", "Frameworx License", "GNU Free Documentation License", "Historical Permission Notice", "IBM Public License", "IPA Font License", "LaTeX Project Public License",
    "Lucent Public License", "Microsoft Public License", "Microsoft Reciprocal License", "MirOS License", "Motosoto License", "Multics License", "NASA Open Source Agreement", "Naumen Public License", "Nethack General Public License", "Non-Profit Open Software License",
    "NTP License", "OCLC Research Public License", "Open Data Commons License", "Open Database License", "Open Government Licence", "Open Group Test Suite License", "Open Software License", "PHP License", "PostgreSQL License", "Python License", "Q Public License",
    "RealNetworks Public Source License", "Reciprocal Public License", "Ricoh Source Code Public License", "Server Side Public License", "SIL Open Font License", "Simple Public License", "Sleepycat License", "Sun Public License", "Sybase Open Watcom License",
    "Universal Permissive License", "Vovida Software License", "W3C Software License", "WTFPL", "X.Net License", "Zlib License", "Zope Public License", "EPL-2.0", "EUPL-1.2", "CDDL-1.0", "BSL-1.0", "OFL-1.1", "GFDL-1.3", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0", "MS-PL",
    "SSPL-1.0", "AFL-3.0", "OSL-3.0", "NCSA", "PSF-2.0", "Artistic-2.0", "CPAL-1.0", "ECL-2.0",
]
#: Notices that the model does not learn from: of its families, in other words, and of other licences.
HELD = {
    "agpl": ["This server is distributed under the GNU Affero General Public License version 3 or later.", "Licensed under the GNU Affero General Public License."],
    "apache": ["This project is licensed under the Apache License, Version 2.0.", "Distributed under the terms of the Apache License 2.0."],
    "bsd": ["This package is released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms are permitted provided that the above copyright notice is retained and the following conditions are met."],
    "cc-by": ["This article is licensed under a Creative Commons Attribution 4.0 International License.", "Text available under CC BY 4.0."],
    "cc-by-nc": ["Photos licensed under CC BY-NC 4.0.", "This chapter is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Content is licensed under CC BY-SA 4.0.", "The text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Data released under CC0 1.0 Universal.", "To the extent possible under law, the curators have waived all copyright and related or neighboring rights to this dataset."],
    "gpl": ["This library is licensed under the GNU General Public License, version 2.", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "isc": ["This module is released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["This code is licensed under the GNU Lesser General Public License, version 3.", "Redistribute it under the terms of the GNU Lesser General Public License."],
    "mit": ["The project is released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "mpl": ["This file is subject to the terms of the Mozilla Public License, v. 2.0.", "Code licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved. No part of this book may be reproduced without the written permission of the copyright holder.", "This document is proprietary and confidential; unauthorized copying is strictly prohibited."],
    "unlicense": ["This is free and unencumbered code released into the public domain.", "Released into the public domain under the Unlicense by its author."],
}
HELD_OTHERS = [
    "Licensed under the Elastic License 2.0.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "You may not use this work except in compliance with the Licence.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: EUPL-1.2",
    "CC BY-ND 4.0",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Released under the Server Side Public License, version 1.",
    "Licensed under the PostgreSQL License.",
    "Distributed under the terms of the Open Software License version 3.0.",
    "This software is governed by the CeCILL license under French law.",
    "Licensed under the Universal Permissive License v 1.0.",
    "This material is available under the Open Government Licence v3.0.",
    "Please read the license agreement before you install the program.",
    "The copyright of the photographs remains with the families of the artists.",
    "Driving without a valid license can lead to a fine of two hundred dollars.",
    "The bar lost its licence after the inspection.",
    *(f.format(t) for t in OTHER_TITLES[1::2] for f in ("{}", "Licensed under the {}.", "License: {}")),
]
#: A line with a word that begins so is a candidate.
CUES = [
    "licen", "sublicen", "unlicen", "copyright", "warrant", "redistribut", "permission", "permitted", "permissive", "domain", "reserved", "proprietary", "commons", "cc by", "cc0", "spdx", "gpl", "agpl", "lgpl", "gnu", "apache", "bsd",
    "mozilla", "mpl", "isc", "foundation", "disclaimer", "compliance", "granted", "hereby", "unencumbered", "waived", "documentation", "restriction", "substantial", "confidential", "prohibited", "reproduced", "modification", "distribute", "universal",
    "applicable law", "conditions", "binary forms", "extent possible", "neighboring rights", "the terms", "any purpose", "person obtaining", "copy of this software", "all copies", "source code form", "may not use", "received a copy", "materials provided", "this file you can obtain", "attribution", "noncommercial", "sharealike", "not be copied", "written consent", "company and may not",
]
#: Words that name a family, and words that name a variant of one.
NAMES = {
    "agpl": ["affero", "agpl", "agplv3"], "apache": ["apache"], "bsd": ["bsd"], "cc-by": ["cc", "commons", "attribution"], "cc-by-nc": ["nc", "noncommercial"], "cc-by-sa": ["sa", "sharealike"], "cc0": ["cc0", "zero"], "gpl": ["gnu", "gpl", "gplv2", "gplv3"],
    "isc": ["isc"], "lgpl": ["lesser", "lgpl", "lgplv2", "lgplv3"], "mit": ["mit"], "mpl": ["mozilla", "mpl"], "proprietary": [], "unlicense": ["unlicense", "unencumbered"],
}
VARIANTS = ["affero", "agpl", "agplv3", "lesser", "lgpl", "lgplv2", "lgplv3", "nd", "nc", "sa", "noderivatives", "noderivs", "noncommercial", "sharealike", "eupl", "elastic"]

FAMILIES = sorted(TEMPLATES)
#: A confirmed paragraph shares so many word pairs (one if it has but one), and so large a part of the smaller side's, with a template.
LEAST_PAIRS, LEAST_SHARE = 2, 0.6
#: What each step of the fit takes off every weight.
SPARSE = 2e-4
#: No family stands on less than this.
LEAST_PROB = 0.5


def grams(text: str, sizes=(1, 2, 3)) -> set[str]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


def _short(family: str, titles: int, ids: int) -> list[str]:
    """Names and identifiers of a family in so many of their sentences."""
    return [f.format(t) for f in TITLE_FRAMES[:titles] for t in TITLES.get(family, ())] + [f.format(i) for f in ID_FRAMES[:ids] for i in IDS.get(family, ())]


def all_templates() -> list[tuple[str, str]]:
    """(family, template): the notices, and the families' names and identifiers in the first of their sentences."""
    return [(f, t) for f in FAMILIES for t in [*TEMPLATES[f], *_short(f, TITLE_TEMPLATES, len(ID_FRAMES))]]


def _variants(rng: random.Random) -> list[tuple[str, str]]:
    fill = " ".join(NEGATIVES).lower().split()
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts * 12:
            w = text.split()
            if len(w) > 8 and rng.random() < 0.5:
                a = rng.randrange(0, len(w) - 6)  # as a wrapped line has a part of it
                w = w[a : a + rng.randrange(7, len(w) - a + 1)]
            w = [x for x in w if rng.random() > 0.04]
            around = [rng.sample(fill, rng.randrange(0, 9)) for _ in range(2)]
            out.append((" ".join(around[0] + w + around[1]), family))
    for family in FAMILIES:
        out += [(t, family) for t in _short(family, len(TITLE_FRAMES), len(ID_FRAMES)) * 3]
    out += [(f.format(t), "unknown") for t in OTHER_TITLES[::2] * 2 for f in TITLE_FRAMES + ID_FRAMES[1:]]
    for text in (NEGATIVES + OTHERS) * 12:
        w = text.split()
        out.append((" ".join(x for x in w if rng.random() > 0.1), "unknown"))
    for _ in range(200):
        out.append((" ".join(rng.sample(fill, rng.randrange(4, 20)) + rng.sample(["license", "licensed", "copyright", "version", "under", "the", "permission", "released"], 2)), "unknown"))
    return out


@lru_cache
def model() -> dict:
    """vocabulary -> weights by class (millionths), biases, temperature and threshold."""
    rng = random.Random(6)
    classes = [*FAMILIES, "unknown"]
    rows = _variants(rng)
    own = [grams(t) for t, _ in rows]
    count: dict[str, int] = {}
    for g in own:
        for x in g:
            count[x] = count.get(x, 0) + 1
    # grams of the templates and of often seen negatives; others say nothing
    vocab = sorted(x for x, n in count.items() if n >= 6)
    at = {g: i for i, g in enumerate(vocab)}

    def matrix(sets):
        x = np.zeros((len(sets), len(vocab)))
        for i, g in enumerate(sets):
            x[i, [at[k] for k in g if k in at]] = 1
        return x

    x, y = matrix(own), np.array([classes.index(c) for _, c in rows])
    hot = np.eye(len(classes))[y]
    # a family of few notices weighs as much as one of many
    size = np.bincount(y, minlength=len(classes))
    weigh = np.where(y < len(FAMILIES), 0.5 * len(y) / (len(FAMILIES) * size[y]), 0.5 * len(y) / size[y])[:, None] / len(y)
    w, b = np.zeros((len(vocab), len(classes))), np.zeros(len(classes))
    for _ in range(400):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot) * weigh
        w -= 2.0 * (x.T @ g)
        b -= 0.5 * g.sum(0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - SPARSE)  # soft threshold: sparse weights
    some = np.abs(w).sum(1) > 0
    whole, bias = np.round(w[some] * 1e6).astype(int), np.round(b * 1e6).astype(int)
    held = [(t, f) for f, texts in HELD.items() for t in texts] + [(t, "unknown") for t in HELD_OTHERS]
    z = matrix([grams(t) for t, _ in held]) @ w + b
    yy = np.array([classes.index(c) for _, c in held])

    def probs(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(probs(t)[np.arange(len(yy)), yy] + 1e-12).mean())
    best = probs(temperature)[:, :-1]
    passing = [float(best[i].max()) for i, (t, f) in enumerate(held) if f == "unknown" and FAMILIES[best[i].argmax()] in confirmed(t)]
    threshold = max([LEAST_PROB, *(p + 1e-6 for p in passing)])
    names = [g for g, s in zip(vocab, some) if s]
    return {"weights": dict(zip(names, whole.tolist())), "bias": bias.tolist(), "temperature": temperature, "threshold": round(threshold, 6)}


def template_pairs() -> list[tuple[str, str, int, int]]:
    """(word pair, family, number of the template, pairs of the template)."""
    out = []
    for i, (family, text) in enumerate(all_templates()):
        pairs = sorted(grams(text, (2,)))
        out += [(p, family, i, len(pairs)) for p in pairs]
    return out


def fixed_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of fixed size from a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _grams_column(sizes) -> str:
    parts = ", ".join(f"CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), i -> concat_ws(' ', {', '.join(f'w[i + {k}]' for k in range(n))})) ELSE cast(array() AS array<string>) END" for n in sizes)
    return f"array_distinct(concat({parts}))"


def template_rules() -> list[tuple[int, list[str], list[str]]]:
    """(number of the template, words of which a confirmed paragraph has one, words of which it has none)."""
    out = []
    for i, (family, text) in enumerate(all_templates()):
        own = grams(text, (1,))
        out.append((i, [n for n in NAMES[family] if n in own], [v for v in VARIANTS if v not in own]))
    return out


def confirmed(text: str) -> set[str]:
    """The families of which a template confirms a text, as `classify` does it for columns."""
    own, words = grams(text, (2,)), grams(text, (1,))
    out = set()
    for (family, template), (_, names, others) in zip(all_templates(), template_rules()):
        pairs = grams(template, (2,))
        n = len(own & pairs)
        if n and n >= min(LEAST_PAIRS, len(own)) and n >= LEAST_SHARE * min(len(own), len(pairs)) and (not names or words & set(names)) and not words & set(others):
            out.add(family)
    return out


#: Matches lower-cased lines with a word that begins with a cue; the words of one may be parted by anything.
CUE_PATTERN = "(^|[^a-z0-9])(" + "|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES) + ")"


def classify(paragraphs: DataFrame) -> DataFrame:
    """key, family of every distinct paragraph (key, para); family is null unless the predicted one is confirmed."""
    spark, m = paragraphs.sparkSession, model()
    n = len(FAMILIES) + 1
    weights = fixed_table(spark, [{"gram": g, "w": w} for g, w in m["weights"].items()], "gram string, w array<bigint>")
    weights = weights.select("gram", *(F.get("w", F.lit(i)).alias(f"w{i}") for i in range(n)))
    words = paragraphs.select("key", F.expr("regexp_extract_all(lower(para), '[a-z0-9]+', 0)").alias("w"))
    sums = words.select("key", F.explode(F.expr(_grams_column((1, 2, 3)))).alias("gram")).join(F.broadcast(weights), "gram")
    sums = sums.groupBy("key").agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(n)))
    z = F.array(*((F.col(f"s{i}") + F.lit(b)).cast("double") for i, b in enumerate(m["bias"])))
    own = F.slice("z", 1, n - 1)
    sums = sums.select("key", z.alias("z")).withColumn("top", F.array_max("z")).withColumn("best", F.array_max(own))
    prob = F.expr(f"1 / aggregate(z, 0D, (s, x) -> s + exp((x - best) / {m['temperature'] * 1e6}))")
    family = F.get(F.array(*map(F.lit, FAMILIES)), F.array_position(own, F.col("best")).cast("int") - 1)
    said = sums.where(prob >= m["threshold"]).select("key", family.alias("family"))

    pairs = words.select("key", F.explode(F.expr(_grams_column((2,)))).alias("gram"), F.expr(f"size({_grams_column((2,))})").alias("own"))
    columns = ("gram", "family", "template", "size")
    known = fixed_table(spark, [dict(zip(columns, r)) for r in template_pairs()], "gram string, family string, template int, size int")
    shared = pairs.join(F.broadcast(known), "gram").groupBy("key", "family", "template").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.max("size").alias("size"))
    shared = shared.where((F.col("n") >= F.least(F.lit(LEAST_PAIRS), "own")) & (F.col("n") >= LEAST_SHARE * F.least("own", "size")))
    rules = fixed_table(spark, [dict(zip(("template", "names", "not_names"), r)) for r in template_rules()], "template int, names array<string>, not_names array<string>")
    shared = shared.join(F.broadcast(rules), "template").join(words, "key")
    shared = shared.where("(size(names) = 0 OR arrays_overlap(w, names)) AND NOT arrays_overlap(w, not_names)").select("key", "family").distinct()
    return paragraphs.select("key").join(said.join(shared, ["key", "family"], "left_semi"), "key", "left")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (array) and n_unknown (candidates without a confirmed family)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.lower(text).alias("low"))
    some = F.lit(False)
    for word in sorted({max(c.split(), key=len) for c in CUES}):  # plain search first, as most texts have none
        some = some | F.contains("low", F.lit(word))
    paras = F.when(some, F.filter(F.split("text", "\n"), lambda p: F.lower(p).rlike(CUE_PATTERN))).otherwise(F.expr("cast(array() AS array<string>)"))
    n_paras = F.expr(r"size(filter(split(text, '\n'), l -> translate(l, ' \t\u000b\u000c\r', '') != ''))").cast("long")
    d = d.select("doc_id", F.md5("text").alias("digest"), n_paras.alias("n_paragraphs"), paras.alias("paras"))
    d = scratch.keep(d, "paragraphs")
    each = d.where("size(paras) > 0").select("doc_id", "digest", F.posexplode("paras").alias("pos", "para")).withColumn("key", F.md5("para"))
    distinct = each.groupBy("key").agg(F.any_value("para").alias("para"))
    verdicts = scratch.keep(classify(distinct), "verdicts")
    judged = join_checked(each.select("doc_id", "digest", "pos", "key"), verdicts, "key", "inner")
    # rows of one id and text are alike, so their paragraphs count once
    per_doc = judged.groupBy("doc_id", "digest").agg(
        F.count_distinct(F.when(F.col("family").isNotNull(), F.col("pos"))).alias("n_licensed"),
        F.sort_array(F.collect_set("family")).alias("families"),
        F.count_distinct(F.when(F.col("family").isNull(), F.col("pos"))).alias("n_unknown"),
    ).withColumnsRenamed({"doc_id": "i", "digest": "g"})
    out = d.select("doc_id", "digest", "n_paragraphs").join(per_doc, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_paragraphs", zero("n_licensed"), F.coalesce("families", F.expr("cast(array() AS array<string>)")).alias("families"), zero("n_unknown"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("families", F.concat_ws(",", "families"))


def sql() -> str:
    m, n = model(), len(FAMILIES) + 1
    q = lambda s: "'" + s.replace("'", "''") + "'"
    weights = ", ".join(f"({q(g)}, {list(w)})" for g, w in m["weights"].items())
    known = ", ".join(f"({q(g)}, {q(f)}, {t}, {s})" for g, f, t, s in template_pairs())
    rules = ", ".join(f"({t}, {names}::VARCHAR[], {others}::VARCHAR[])" for t, names, others in template_rules())
    each_gram = lambda k: f"list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))"
    sums = ", ".join(f"sum(ws[{i + 1}]) + {b} AS s{i}" for i, b in enumerate(m["bias"]))
    own = "[" + ", ".join(f"s{i}" for i in range(n - 1)) + "]"
    exps = " + ".join(f"exp((s{i} - best) / {m['temperature'] * 1e6})" for i in range(n))
    return rf"""
WITH weights(gram, ws) AS (VALUES {weights}),
known(gram, family, template, size) AS (VALUES {known}),
rules(template, names, not_names) AS (VALUES {rules}),
p AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS para FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
c AS (SELECT * FROM p WHERE regexp_matches(lower(para), '{CUE_PATTERN}')),
d AS (SELECT para, regexp_extract_all(lower(para), '[a-z0-9]+') AS w FROM (SELECT DISTINCT para FROM c)),
g AS (SELECT DISTINCT para, unnest(list_concat({each_gram(1)}, list_concat({each_gram(2)}, {each_gram(3)}))) AS gram FROM d),
s AS (SELECT para, {sums} FROM g JOIN weights USING (gram) GROUP BY para),
b AS (SELECT *, list_max({own}) AS best FROM s),
said AS (SELECT para, {FAMILIES}[list_position({own}, best)] AS family FROM b WHERE 1 / ({exps}) >= {m["threshold"]}),
pairs AS (SELECT DISTINCT para, gram FROM (SELECT para, unnest({each_gram(2)}) AS gram FROM d)),
sizes AS (SELECT para, count(*) AS own FROM pairs GROUP BY para),
shared AS (SELECT DISTINCT para, family FROM (SELECT para, family, template, count(*) AS n, max(own) AS own, max(size) AS size
  FROM pairs JOIN sizes USING (para) JOIN known USING (gram) GROUP BY ALL) JOIN rules USING (template) JOIN d USING (para)
  WHERE n >= least({LEAST_PAIRS}, own) AND n >= {LEAST_SHARE} * least(own, size) AND (len(names) = 0 OR list_has_any(w, names)) AND NOT list_has_any(w, not_names)),
v AS (SELECT said.para, said.family FROM said JOIN shared USING (para, family)),
j AS (SELECT doc_id, count(*) FILTER (family IS NOT NULL) AS yes, count(*) FILTER (family IS NULL) AS no, string_agg(DISTINCT family, ',' ORDER BY family) AS families
  FROM c LEFT JOIN v USING (para) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) FILTER (regexp_matches(para, '[^\x20\x09-\x0D]')) AS n FROM p GROUP BY doc_id)
SELECT doc_id, n.n::BIGINT AS n_paragraphs, coalesce(yes, 0)::BIGINT AS n_licensed, coalesce(families, '') AS families, coalesce(no, 0)::BIGINT AS n_unknown
FROM n LEFT JOIN j USING (doc_id)
"""
