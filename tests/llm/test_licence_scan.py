"""The licence scan against comparing every unit with every template."""

import re
import textwrap

from gaugework.llm import licence_scan


def expected(rows):
    table = [(n, set(licence_scan.bigrams(licence_scan.plain_words(t)))) for n, texts in licence_scan.TEMPLATES.items() for t in texts]
    out = []
    for doc, text in rows:
        plain = re.sub(r"[^\w\n]+|_+", " ", (text or "").lower())
        parts = re.split(r"\n(?: ?\n)+", plain)
        units = [("line", i, x) for i, x in enumerate(plain.split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(parts) if "\n" in x.strip(" ")] + [("text", 0, plain)] * (len(parts) > 1)
        for unit, place, words in units:
            grams = set(licence_scan.bigrams(words.split()))
            best = min((-2 * len(grams & g) / (len(grams) + len(g)), n) for n, g in table)
            if best[0] <= -0.8:
                out.append((doc, unit, place, best[1], -best[0]))
    return sorted(out, key=repr)


def test_every_kind_of_row(spark, docs, corpus, no_docs):
    mit, apache = licence_scan.TEMPLATES["MIT"], licence_scan.TEMPLATES["Apache-2.0"]
    wrapped = "\n".join(mit[3][i : i + 70] for i in range(0, len(mit[3]), 70))
    texts = [
        mit[0], mit[0].upper(), "Hello.\n  " + apache[0] + "\nmore", "released under the mit", wrapped, f"Title\n\n{wrapped}", f"{apache[1]} and so on",
        "licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0!", "license " * 30, apache[0] * 3, mit[3].replace("Software", "Work"),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, mit[0]), (None, mit[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert sorted(map(tuple, licence_scan.scan(df).collect()), key=repr) == want and len(want) > 10
    assert sorted(map(tuple, licence_scan.scan(docs).collect()), key=repr) == expected([r[:2] for r in corpus])
    assert licence_scan.scan(no_docs).collect() == []


def test_anchors_are_in_every_match():
    grams = [f"word{i} thing{i}" for i in range(20)]
    kept = licence_scan.shared_least(20, 0.8)
    assert kept == 14 and len(licence_scan.anchors(grams, 0.8)) == 7


def spans(text):
    """Every window of every template by brute force, then the best that do not overlap."""
    words, found = re.sub(r"[\W_]+", " ", text.lower()).split(), []
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, texts in licence_scan.span_templates().items():
        for grams in (set(licence_scan.bigrams(licence_scan.plain_words(t))) for t in texts):
            at = [i for i, p in enumerate(pairs) if p in grams]
            for a in at:
                for b in (b for b in at if a <= b < a + int(1.5 * len(grams) + 1e-9)):
                    held = set(pairs[a : b + 1])
                    dice = 2 * len(held & grams) / (len(held) + len(grams))
                    if dice >= 0.8:
                        found.append((len(grams) + len(held) - 3 * len(held & grams), -dice, a, b + 2, name))
    taken = []
    for x in sorted(found):
        if all(x[3] <= y[2] or y[3] <= x[2] for y in taken):
            taken.append(x)
    return sorted((x[2], x[4], -x[1]) for x in taken)


def test_notices_that_fill_no_unit(spark):
    mit, apache = licence_scan.TEMPLATES["MIT"], licence_scan.TEMPLATES["Apache-2.0"]
    bsd3, cc0 = licence_scan.NOTICES["BSD-3-Clause"][0], licence_scan.NOTICES["CC0-1.0"][0]
    wrap = lambda t: "\n".join(" # " + x for x in textwrap.wrap(t, 60))
    story = " ".join(f"story{i} told{i % 7}" for i in range(60))
    gnu = {n: licence_scan.NOTICES[n][0] for n in ("GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause")}
    texts = [
        f"{story} {mit[0]} {story} {apache[0]} {story}", f"{wrap(story)}\n{wrap(bsd3)}\n{wrap(story)}", f"{story}\n{cc0} {story}",
        f"{story} {wrap(apache[1])} {wrap(story)}", *(f"{story} {t} {story}" for t in gnu.values()), f"{mit[0]} {story} {mit[0]} {mit[1]}",
        f"{story} {bsd3.replace('copyright holder', 'Regents of the University')} {story}", f"{mit[3]} {licence_scan.TEMPLATES['CC-BY-4.0'][0]}",
    ]
    got = licence_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    made = {i: sorted((r["place"], r["licence"], r["dice"]) for r in got if r["doc_id"] == i and r["unit"] == "span") for i in range(len(texts))}
    for i, text in enumerate(texts[:-1]):
        assert made[i] == spans(text), text
    names = [[x[1] for x in made[i]] for i in range(len(texts))]
    assert names[:4] == [["MIT", "Apache-2.0"], ["BSD-3-Clause"], ["CC0-1.0"], ["Apache-2.0"]]
    assert names[4:9] == [[n] for n in gnu] and names[9:] == [["MIT"] * 3, ["BSD-3-Clause"], ["CC-BY-4.0"]]
    assert {(r["unit"], r["licence"]) for r in got if r["doc_id"] == len(texts) - 1} == {("line", "MIT"), ("span", "CC-BY-4.0")}
