import re

from websource_audit.llm import license_scan as L

TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "x Under--the MIT\nlicense y. CC BY-NC 4.0 cc by nc cc by nc",
    "Licensed under the Apache License, Version 2.0.\nother\nThis work is licensed under the GNU General Public License, version 3.",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation",
    "LICENSED UNDER cc by-nc é apache license version 2" + " filler" * 20_000,
    "released under the license",
    "...",
]


def brute(text):
    words = re.sub(L.GAPS, " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split()
    places = [(k, label) for p, label in L.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    found = []
    for b, line in enumerate((text or "").split("\n")):
        own = set(re.sub(L.GAPS, " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)).split())
        for t, (_label, template) in enumerate(L.TEMPLATES):
            ts = set(L.template_tokens(template))
            if len(ts & own) >= L.need(len(ts)):
                found.append((b, t, len(ts & own)))
    return len(words), sorted(places), sorted(found)


def test_equals_brute_force(spark, documents):
    rows = L.scan_licenses(documents(TEXTS).withColumnRenamed("lang", "matches")).collect()
    got = {r.id: (r.n_words, sorted((p.start, p.label) for p in r.places), sorted((m.block, m.template, m.shared) for m in r.matches)) for r in rows}
    assert got == {k: brute(t) for k, t in enumerate(TEXTS)}


def test_threshold_and_rows(spark, documents):
    low = L.license_blocks(documents(TEXTS), percent=50)
    assert low.count() > L.license_blocks(documents(TEXTS)).count() > 0
    assert L.scan_licenses(documents([])).count() == 0


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation\n * files (the \"Software\")"
BSD = "Redistribution and use in source and binary forms, with or without\r\n// modification, are permitted provided that"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"
WRAPPED = [
    (MIT, {"mit"}),
    (BSD, {"bsd"}),
    ("int x;\n\n# " + MPL + "\n#\n# y", {"mpl-2"}),
    (MPL.replace("Mozilla Public\n", "Mozilla Public\n *\n\n"), set()),
    ("Licensed under CC BY 4.0.", {"cc-by"}),
    ("Licensed under CC\nBY-NC 4.0.", {"cc-by", "cc-by-nc"}),
    (" filler filler ".join(MIT.split()), set()),
    ("so " * 5000 + "\n" + MIT + "\n" + "so " * 5000, {"mit"}),
    (None, set()),
]


def test_wrapped_templates_are_met_in_paragraphs(spark, documents):
    rows = L.scan_licenses(documents([t for t, _ in WRAPPED]), paragraphs=True).collect()
    assert {r.id: {m.label for m in r.matches} for r in rows} == {k: want for k, (_, want) in enumerate(WRAPPED)}
    assert {r.id: [(m.block, m.template, m.shared) for m in r.matches] for r in rows}[2] == [(1, 7, 16)]
