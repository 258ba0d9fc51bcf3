import math
import random
import re

from loomspark.llm import license as lic


def test_held_out_accuracy():
    model = lic.train()
    data = lic.training_set(seed=99)
    right = sum(model.family(t)[0] == f for t, f in data) / len(data)
    false = sum(f == lic.NONE and model.family(t)[0] not in (lic.NONE, lic.UNKNOWN) for t, f in data)
    assert right > 0.96 and false <= 3
    for family, notices in lic.NOTICES.items():
        assert all(model.family(n)[0] == family for n in notices), family
    assert all(model.family(s)[0] in (lic.NONE, lic.UNKNOWN) for s in lic.ORDINARY)


def test_scan(spark):
    rows = [(1, "Some prose here.\nReleased under the MIT License."), (2, None), (3, ""), (4, "x " * 50_000), (1, "Licensed under CC BY-NC 4.0.\n\nAll rights reserved.\nAll rights reserved."), (None, "plain")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, families int")
    got = sorted(((r.doc_id or 0, r.n_paragraphs, r.n_licences, r.families, r.main_family) for r in lic.licence_scan(df).collect()), key=str)
    assert got == [(0, 1, 0, "", None), (1, 2, 1, "MIT", "MIT"), (1, 3, 3, "CC-BY-NC,Proprietary", "Proprietary"), (2, 0, 0, "", None), (3, 0, 0, "", None), (4, 1, 0, "", None)]
    assert lic.licence_scan(df.where("false")).count() == 0


def test_wrapped_notices():
    model = lic.train()
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights'
    for family, notice in (("BSD", bsd), ("GPL", gpl), ("MIT", mit)):
        for text in (notice, f"Some prose here.\n\n{notice}\n\nMore prose.", f"Some prose here.\n{notice}", "\n".join(" * " + x for x in notice.split("\n"))):
            assert lic.scan(text, model)[1:] == (1, 0, family, family), (text, lic.scan(text, model))
    assert lic.scan(f"{bsd}\n\n{gpl}\nReleased under the MIT License.", model)[1:4] == (3, 0, "BSD,GPL,MIT")
    assert lic.scan("The general public may use\nthe library free of charge.", model)[1] == 0


#: Wordings that the module doesn't hold.
HELD_OUT = {
    "Apache": "This file is licensed to you under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY": "Except where otherwise noted, content is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC": "The data are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "GPL": "You can redistribute this file under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.",
    "LGPL": "You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "MIT": "This package is licensed under the MIT license, see the file for details.",
    "MPL": "The contents of this file are licensed under the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright 2020 Some Company. All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def test_whole_notices_held_out():
    model = lic.train()
    got = {f: model.family(t)[0] for f, t in HELD_OUT.items()}
    assert all(g in (f, lic.UNKNOWN) for f, g in got.items()), got
    assert sum(g == f for f, g in got.items()) >= 7, got


def test_against_a_plain_scorer():
    """Families by dictionaries and sums, one n-gram at a time."""
    model = lic.train()
    r = random.Random(2)
    texts = [t for t, _ in lic.training_set(17, 10)] + [" ".join(r.choice(list(model.vocabulary)) for _ in range(r.randint(0, 12))) for _ in range(100)]
    for text in texts:
        words = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())
        grams = {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)} & set(model.vocabulary)
        sums = {c: float(model.bias[j]) + sum(float(model.weights[model.vocabulary[g], j]) for g in grams) / math.sqrt(max(1, len(grams))) for j, c in enumerate(model.classes)}
        top = max(sums.values())
        share = {c: math.exp((v - top) / model.temperature) for c, v in sums.items()}
        best = max(share, key=share.get)
        p = share[best] / sum(share.values())
        near = any(len(n & {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}) >= len(n) / 2 for n in lic._notice_grams(best)) if best != lic.NONE else True
        want = best if best == lic.NONE or p >= model.threshold and near else lic.UNKNOWN
        family, got = model.family(text)
        assert family == want and abs(got - p) < 1e-9
