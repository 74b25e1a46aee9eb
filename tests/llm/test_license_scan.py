"""The licence scan against a plain version over words and places."""

import re

from knowspark.llm import license_scan as L

WORD = re.compile(L.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs):
    files = [(d, words(t)) for d, t in docs]
    holds = {w: sum(w in f for _, f in files) for w in L.vocabulary()}
    out = []
    for d, w in files:
        stand = lambda phrase, at: 0 <= at and w[at:at + len(phrase)] == phrase
        base = [(i, label) for label, text in L.BASE for i in range(len(w)) if stand(text.split(), i)]
        named, score = {label for _, label in base}, 1.0 if base else 0.0
        for label, text, phrases in L.TEMPLATES:
            t = text.split()
            rare = sorted(set(t), key=lambda x: (holds[x], x))[:L.RARE]
            votes = {}
            for r in rare:
                for p in (i for i, x in enumerate(w) if x == r):
                    for q in (i for i, x in enumerate(t) if x == r):
                        votes.setdefault(p - q, set()).add(r)
            origins = [o for o, who in votes.items() if len(who) >= L.AGREE]
            for o in origins:
                score = max(score, sum(0 <= o + j < len(w) and w[o + j] == x
                                       for j, x in enumerate(t)) / len(t))
            if all(any(stand(p.split(), o + q) for o in origins for q in L.places(p, text))
                   for p in phrases):
                named.add(label)
        at = [i for i, _ in base]
        out.append((d, len(w), len(at), min(at, default=None), max(at, default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(named)), score))
    return sorted(out, key=repr)


def run(docs):
    got = L.scan(docs)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                           "labels", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


LINES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
         "This work is licensed under the GNU General Public License, version 3.",
         "Licensed under CC BY-NC 4.0.", "All rights reserved. ALL RIGHTS RESERVED",
         "cc by cc by cc", "General-Public_License general public\nlicence", "mit license",
         "the mit licence of a licensed apache version", "all rights all rights reserved",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
         "software and associated documentation files (the \"Software\")",
         "Redistribution and use in source and binary forms, with or without modification, are "
         "permitted provided that the following conditions are met:", "under the terms of the GNU Lesser General Public Licens",
         "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
         "without fee is hereby granted"]


def test_as_the_plain_version(spark, docs_of, odd_docs):
    docs = odd_docs + [(100 + i, t) for i, t in enumerate(LINES)]
    docs += [(200 + i, " ".join(LINES[(i * k) % len(LINES)] + " filler é" for k in range(1, 5)))
             for i in range(20)]
    docs += [(300, "x " * 20_000 + " ".join(LINES) * 30)]
    want = plain(docs)
    assert run(docs_of(docs)) == want
    assert {"cc-by", "gpl", "reserved", "mit", "bsd", "isc", "gpl-3.0", "apache-2.0", "cc-by-nc"} <= {
        x for r in want for x in r[6].split(",")}


def test_nothing_to_scan(spark, docs_of):
    assert run(docs_of([])) == []
    assert run(docs_of([(None, None), (1, ""), (1, "")])) == plain([(None, None), (1, ""), (1, "")])


def test_no_python_in_the_plan(spark, docs_of):
    plan = L.scan(docs_of([(1, LINES[0])]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Project")[0]
