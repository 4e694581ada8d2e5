"""Chunk recipes, source divergence and delta Lloyd against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import chunk_recipes, delta_lloyd, divergence, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, recipe string, kept string, term string, n int"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns named like the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", "y", "z", 2) for r in rows], DOCS)


def words(n, seed):
    deal = random.Random(seed)
    return " ".join(deal.choice(["dawn", "Übung", "кот", "sea-side", "42", "e.g.", "x" * 40]) for _ in range(n))


def odd_rows():
    long = words(30_000, 1)
    texts = [None, "", " ", "\t\n ", "a b", "a  b", "a b", " a b", "a b ", "a\x0b\x0c\rb", "A b", long, long.replace(" ", " \n"), long + ".", "x" * 100_000, "x" * 100_001, "x" * 100_000]
    texts += [words(400, s % 3) for s in range(12)] + [words(400, 1)[:-1] + "!"]
    rows = [(100 - i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (96, "a b", None, None), rows[0], rows[7]]


def plain_copies(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[norm(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept = ids.index(first)
        out += [(i, first, len(ids), k == kept, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("mark", [chunk_recipes.fingerprint, F.length, lambda c: F.lit(1)])
def test_copies(spark, mark):
    """With good identifiers, and with those that many contents share."""
    rows = odd_rows()
    got = chunk_recipes.copies(documents(spark, rows).repartition(5), mark)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == plain_copies(rows)


def test_copies_of_nothing(spark):
    assert chunk_recipes.copies(documents(spark, [])).collect() == []


def test_chunks_follow_content(spark):
    """Chunks make up the text, and an insertion changes those near it alone."""
    text = " ".join(f"word{random.Random(i).random()}" for i in range(8000))
    df = spark.createDataFrame([(text,), (text[:60_000] + " new " + text[60_000:],), ("ж" * 20_000,)], "text string")
    a, b, c = (r[0] for r in df.select(chunk_recipes.chunks(F.col("text"))).collect())
    assert "".join(a) == text and "".join(c).encode("latin-1").decode() == "ж" * 20_000
    assert len(a) > 40 and len(set(a) - set(b)) <= 2
    assert max(map(len, a + b + c)) <= chunk_recipes.MOST


def plain_audit(rows, least, top):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        found = re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode().lower())
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
        langs[lang or ""].add(source or "")
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        shares = {}
        every = Counter()
        for s in sources:
            every.update({t: counts[lang, s][t] for t in kept})
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, every)]:
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pair = [(-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(shares[s][t], shares[None][t]), t) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    deal = random.Random(5)
    vocabulary = ["Sea", "sea", "Élan", "élan", "кот", "día", "don't", "a1b", "z", "日本語", "naïve"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(deal.choice(vocabulary) for _ in range(deal.randrange(60))), deal.choice(["en", "en", "en", "de", None, "lone"]), deal.choice(["s1", "s1", "s2", "S2", None, "ü"])) for i in range(300)]
    rows += [(1, None, "en", "silent"), (2, "", "en", "silent"), (3, "123 !", "new", "a"), (3, "rare", "new", "b"), (4, "sea " * 20_000, "en", "s1"), (None, "x", "solo", "one"), rows[0], rows[0]]
    for least, top in ((10, 10), (1, 3)):
        got = divergence.audit(documents(spark, rows).repartition(3), least, top).collect()
        assert sorted(map(tuple, got)) == plain_audit(rows, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).collect() == []


def test_shares_of_large_counts(spark):
    for n, whole in ((10**13, 4 * 10**15), (0, 8 * 10**15), (7, 9)):
        assert spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(whole).cast("long"))).first()[0] == 1 + 10**9 * (n + 2) // whole


def plain_lloyd(rows, k, rounds, seed, size):
    fit = lambda e: e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)
    vectors = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if fit(e)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(vectors, key=rank)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        owners = [nearest(v) for _, v in vectors]
        for c in range(len(centroids)):
            if mine := [v for (_, v), o in zip(vectors, owners) if o == c]:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    ends = [(i, c := nearest(v), far(v, centroids[c])) for i, v in vectors]
    own = Counter()
    for _, c, d in ends:
        own[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in ends), key=str)


@pytest.mark.parametrize("rows_of", ["clusters", "ties", "few", "odd"])
def test_clusters(spark, rows_of):
    deal = random.Random(9)
    make = lambda: [deal.gauss(0, 1) for _ in range(4)]
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0, 0.5]), (4, [1.0, float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0] * 3), (7, [1.0] * 5)]
    rows = {
        "clusters": [(i, [x + 3 * (i % 5) for x in make()]) for i in range(400)],
        "ties": [(i % 30, [float(i % 3), 0.0, float(-(i % 2)), 0.5]) for i in range(200)],
        "few": [(i, make()) for i in range(3)],
        "odd": [*odd, (None, make()), (None, make()), *((i, make()) for i in range(10)), (3, [0.25] * 4), (3, [0.25] * 4), (3, [-0.0001] * 4)],
    }[rows_of]
    df = spark.createDataFrame([(i, e, 0, "a", 1.5) for i, e in rows], "vec_id long, embedding array<double>, owner int, v string, distance double").repartition(3)
    got = sorted((tuple(r) for r in delta_lloyd.clusters(df, 8, 10, 3, 4).collect()), key=str)
    assert got == plain_lloyd(rows, 8, 10, 3, 4)


def test_clusters_of_nothing(spark):
    made = delta_lloyd.clusters(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 8, 10, 3, 64)
    assert made.collect() == [] and made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    made, want = queries.queries()[name](spark, data), con.sql(queries.oracle_sql()[name])
    order = sorted(made.columns)
    assert order == sorted(want.columns)
    told = lambda rows, columns: sorted(repr(tuple(r[columns.index(c)] for c in order)) for r in rows)
    assert told([tuple(r) for r in made.collect()], made.columns) == told(want.fetchall(), want.columns)
