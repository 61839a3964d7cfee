"""The corpus pipeline: its stages' invariants, planted cases, and edge cases."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from tessera.llm import packing, simhash
from tessera.llm.common import table


def prose(seed, n, letters="etaoinshrdlu"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(n))


def planted(spark):
    base = [prose(k, 120) for k in range(30)]
    near = base[3].split()
    near[60] = "edited"
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(109, base[9], "en"), (109, base[9], "en")]
    rows += [(100, base[0], "en"), (101, base[0], "en"), (102, " ".join(near), "en"), (103, "12345 !!", None), (104, None, "en"), (105, "", None), (106, base[5] + " jo.doe@corp.example.com", None), (107, prose(77, 5000), "en"), (108, prose(78, 40), None), (108, prose(79, 40), None), (None, prose(80, 40), "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, blocks string")


def test_stages_over_planted_cases(spark):
    docs = planted(spark)
    columns = docs.columns
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        rows = docs.collect()
        by[name] = rows
        if name != "packed":
            assert docs.columns == columns
            assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
    ids = {name: [r["doc_id"] for r in rows] for name, rows in by.items()}
    clean = {*range(30), 107}
    assert clean <= set(ids["language_id"]) and not {103, 104, 105} & set(ids["language_id"])
    assert clean <= set(ids["line_dedup"]) and not {100, 101} & set(ids["line_dedup"])
    assert clean <= set(ids["near_dedup"]) and 102 not in ids["near_dedup"] and ids["near_dedup"].count(108) == 2 and None in ids["near_dedup"]
    assert not any("jo.doe@corp" in r["text"] for r in by["private"])
    assert set(ids["packed"]) == set(ids["private"])
    assert len({r["sequence_id"] for r in by["packed"]}) == -(-sum(r["length"] for r in by["packed"]) // packing.LENGTH)


def test_an_empty_table(spark):
    docs = planted(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_near_duplicates_that_stay_are_one_of_each_group(spark, data):
    docs = table(spark, data, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs, data)
    groups = simhash.similar_groups(docs).select("component_id").distinct().count()
    assert kept.count() == groups == kept.select("doc_id").distinct().count()


def jaccard_groups(texts, words=5, similarity=0.8):
    """By brute force: for each text the smallest number of a text that it reaches."""
    sets = []
    for t in texts:
        ws = t.lower().split()
        sets.append({" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= similarity * len(a | sets[j]) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(r, text, n):
    ws = text.split()
    for _ in range(n):
        at = r.randrange(len(ws))
        ws[at : at + r.choice((0, 1, 1, 2))] = [prose(r.random(), 1)] * r.choice((0, 1, 1, 2))
    return " ".join(ws)


def test_groups_are_those_of_brute_force(spark):
    """Families whose members are alike, but often not enough to be linked: most buckets' pivots are unlinked to most members."""
    r = random.Random(8)
    texts = [prose(k, 150) for k in range(40)]
    for family in range(4):
        base = prose(1000 + family, 150 + 60 * family)
        texts += [edited(r, base, r.randint(1, 9 + 5 * family)) for _ in range(60)]
        # A second family that shares most of the first, beside which its members are alike.
        ws = base.split()
        other = " ".join(ws[: len(ws) * 3 // 4] + prose(2000 + family, len(ws) // 4).split())
        texts += [edited(r, other, r.randint(0, 6)) for _ in range(30)]
        # Parts of one text.
        texts += [" ".join(ws[i : i + len(ws) * 7 // 10]) for i in range(0, len(ws) // 3, 4)]
    texts += ["", "  ", "one", "one two"]
    r.shuffle(texts)
    expected = jaccard_groups(texts)
    assert len(set(expected)) > 60 and max(Counter(expected).values()) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = simhash.similar_groups(docs).collect()
    assert {x["doc_id"]: x["component_id"] for x in rows} == dict(enumerate(expected))
    assert all(x["stays"] == (x["doc_id"] == x["component_id"]) for x in rows)


def test_recall_by_similarity(spark):
    """Pairs of each similarity from 0.8: at least 0.99 are linked; below: none."""
    r, pairs = random.Random(5), defaultdict(list)
    for k in range(1500):
        a = prose(5000 + k, 120)
        pairs[k] = [a, edited(r, a, r.randint(1, 4))]
    flat = [t for k in pairs for t in pairs[k]]
    alike = {k: jaccard_groups(pairs[k])[1] == 0 for k in pairs}
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(flat)), "doc_id long, text string")).collect()
    linked = {x["doc_id"] // 2 for x in rows if x["doc_id"] % 2 and x["component_id"] == x["doc_id"] - 1}
    assert linked <= {k for k in alike if alike[k]}
    assert len(linked) >= 0.99 * sum(alike.values()) > 300


def test_near_duplicates_are_those_of_the_fingerprints_too(spark):
    """Near copies under a similarity of 0.8 whose fingerprints link: one stays, as of the copies that link through a third."""
    r, pairs = random.Random(3), []
    for k in range(2000):
        a = prose(9000 + k, 150)
        b = edited(r, a, 5)
        x, y = (simhash.fingerprint(t.encode()) for t in (a, b))
        if ((x ^ y) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE and jaccard_groups([a, b]) == [0, 1]:
            pairs.append((a, b))
    assert len(pairs) >= 3
    rows = [(2 * k + i, t, "en", "s", len(t)) for k, pair in enumerate(pairs) for i, t in enumerate(pair)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(x["doc_id"] for x in kept.collect()) == [2 * k for k in range(len(pairs))]
