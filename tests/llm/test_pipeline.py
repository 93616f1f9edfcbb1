"""The pipeline's stages take effect on planted cases and leave clean documents alone."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def planted(spark, data, tmp_path_factory):
    """The documents with planted cases: ids from 100000 on."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    rnd = random.Random(9)
    vocab = [w for r in docs.filter("lang = 'en'").limit(40).collect() for w in r["text"].split() if w.isalpha()]
    clean = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    a, b = clean(6000), clean(200)  # long enough for one edit to stay within three bits
    near = a.split()
    near[150] = "altered"
    rows = [(100000, a), (100001, a), (100002, " ".join(near)), (100003, b + " " + item + " " + clean(50)), (100004, clean(80) + ' token = "' + "0af9" * 10 + '" ' + clean(80)), (100005, "12 34 !!"), (100006, clean(120)), (100007, None), (100007, None)]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, items string")
    out = str(tmp_path_factory.mktemp("planted"))
    docs.withColumn("items", F.lit("y")).unionByName(more).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, planted)
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns, name
            docs = P.written(docs, "test")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] >= 100000})
        if name == "secrets":
            t = docs.filter("doc_id = 100004").first()
            assert "[SECRET]" in t["text"] and "0af9" not in t["text"] and t["n_chars"] == len(t["text"])
    assert seen[0] == {100000, 100001, 100002, 100003, 100004, 100006}
    assert seen[1] == {100000, 100003, 100004, 100006}
    assert seen[2] == {100000, 100004, 100006} == seen[3] == seen[4]
    row = docs.filter("doc_id = 100006").first()
    assert row["n_tokens"] == len(row["ids"]) > 100
    whole = P.run(spark, planted)
    assert {r["doc_id"] for r in whole.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_empty(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.written(stage(spark, docs, planted), "test-empty")
    assert docs.count() == 0


def test_near_copies_of_any_length_go(spark):
    """Edited copies against brute force: five-word Jaccard similarity of 0.8 or more."""
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts = []
    for k in range(120):
        a = [rnd.choice(vocab) for _ in range((60, 300, 1000)[k % 3])]
        b = list(a)
        for at in rnd.sample(range(len(b)), 1 if k % 2 else max(1, len(b) // (60 if k % 4 else 30))):
            b[at] = "altered"
        texts += [" ".join(a), " ".join(b)]
    texts += [" ".join(["altered", *texts[2].split()[1:]])] * 2 + ["", None, "two words", "Two  words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert len(set(root)) < len(texts) - 60
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == set(root)


def test_near_copies_come_by_wide_fingerprints(spark, monkeypatch):
    """The SimHash radius decides what is compared: at none, only equal fingerprints meet."""
    rnd = random.Random(5)
    a = [[f"w{rnd.randrange(3000)}" for _ in range(n)] for n in (60, 300, 1000)]
    docs = spark.createDataFrame([(2 * k + i, " ".join(["altered", *w[1:]] if i else w)) for k, w in enumerate(a) for i in (0, 1)], "doc_id long, text string")
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == {0, 2, 4}
    monkeypatch.setattr(P.near_texts, "radius", lambda threshold: 0)
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == set(range(6))


def test_fingerprint_cells_miss_no_near_pair():
    """Pairs of similarity 0.8 or more, from four shingles on, among unrelated texts: each meets in some cell, as a loop over all its cells finds."""
    N, rnd = P.near_texts, random.Random(6)
    word = lambda: f"w{rnd.randrange(10**6)}"
    sets = []
    for k in range(300):
        a = [word() for _ in range((8, 14, 30, 100, 400)[k % 5])]
        b = a + [word() for _ in range(max(1, (len(a) - 4) // 4))]  # 0.8 at the least
        sets += [N.shingles(" ".join(w).encode()) for w in (a, b)]
    assert min(len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(sets[::2], sets[1::2])) >= 0.8
    sets += [N.shingles(" ".join(word() for _ in range(50)).encode()) for _ in range(2000)]
    words = np.stack([N.wide_fingerprint(x) for x in sets])
    first, met = words.view(np.uint8) & ((1 << N.CELL_BITS) - 1), np.zeros(300, dtype=bool)
    for byte in range(N.BITS // 8):
        for value in np.unique(first[:, byte]):
            at = np.flatnonzero(first[:, byte] == value)
            root = N.cell_components(words[at], byte << N.CELL_BITS | int(value), N.radius(0.8), N.differing(0.8))
            label = dict(zip(at.tolist(), root.tolist()))
            met |= [label.get(2 * k, -1) == label.get(2 * k + 1, -2) for k in range(300)]
    assert met.all()


def test_a_large_cell_is_searched_as_all_pairs_would():
    """A dense group and a loose one among unrelated fingerprints: components of the links that all pairs have."""
    N, rng = P.near_texts, np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (1200, 4), dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, (1200, 4), dtype=np.uint64)
    for members, flips in ((range(100, 500), 10), (range(600, 640), 25)):
        for k in members:
            bits = np.unpackbits(words[members[0]].view(np.uint8))
            bits[rng.permutation(N.BITS)[: flips if k > members[0] else 0]] ^= 1
            words[k] = np.packbits(bits).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= N.radius(0.8), 1))
    want = N.roots(len(words), a, b)
    assert (N.cell_components(words, 7 << N.CELL_BITS, N.radius(0.8), N.differing(0.8)) == want).all() and len(set(want)) == 1200 - 399 - 39


def test_each_set_is_one_row_however_many_cells_it_is_in(spark, monkeypatch):
    """Sixty loose copies that meet in most cells but do not link, twelve of them with a copy that does: no table of groups has a set twice."""
    N, rnd = P.near_texts, random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    changed = lambda w, at: [f"x{rnd.randrange(10**6)}" if i in at else v for i, v in enumerate(w)]
    loose = [changed(base, set(rnd.sample(range(5, 395), 7))) for _ in range(60)]
    texts = [" ".join(w) for w in loose] + [" ".join(changed(w, {0})) for w in loose[::5]]
    sets = [N.shingles(t.encode()) for t in texts]
    links = [(i, j) for j in range(72) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert links == [(5 * k, 60 + k) for k in range(12)]
    rows, write = {}, N.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(N, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in P.near_dedup_stage(spark, docs, "").collect()} == set(range(60))
    assert rows["near-members"] > 5 * 72 and rows["near-open"] == 72  # before: 32 rows a set at most


def test_group_links_connect_what_all_pairs_would():
    """Random groups, some linked in part already, with sets at exactly 0.8: the same components as all pairs give."""
    N, rng = P.near_texts, np.random.default_rng(2)
    for k in range(150):
        bases = [np.unique(rng.integers(0, 400, rng.integers(4, 60))).astype(np.uint64) for _ in range(3)]
        sets = [np.unique(np.concatenate([b[rng.random(len(b)) >= rng.choice([0, 0.05, 0.1, 0.2])], rng.integers(500, 2000, rng.integers(1, 6)).astype(np.uint64)])) for b in (bases[rng.integers(3)] for _ in range(rng.integers(2, 60)))]
        sets += [np.arange(3000 + 100 * n, 3000 + 100 * n + x, dtype=np.uint64) for n in (4, 8, 12, 28) for x in (n, n + n // 4)]  # 0.8
        root = rng.integers(0, len(sets), len(sets)) if k % 2 else np.arange(len(sets))
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (n := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
        same = [(int(np.flatnonzero(root == r)[0]), i) for i, r in enumerate(root)]
        found, want = (N.roots(len(sets), *np.array([*same, *links]).T) for links in (N.group_links(root, sets, 0.8), pairs))
        assert (found == want).all()


def test_clashing_names(spark, planted):
    """Extra columns with names that stages use inside pass through, and decisions stay the same."""
    docs = spark.read.parquet(f"{planted}/documents.parquet").drop("items").filter("doc_id < 40 OR doc_id >= 100000")
    names = ["_id", "_digest", "_found", "_clean", "_twice", "host", "best", "prior", "said", "row", "none", "id", "digest", "key", "clean", "found", "kept", "doc", "spans", "words", "a.b"]
    more = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in P.STAGES[:-1]:
        docs, more = (P.written(stage(spark, d, planted), "test-names") for d in (docs, more))
        assert more.columns == [*docs.columns, *names], name
        assert sorted(map(str, docs.collect())) == sorted(map(str, more.select(*docs.columns).collect())), name
    assert more.filter(F.col("_id") != F.concat(F.lit("_id "), F.col("doc_id").cast("string"))).count() == 0
    assert P.bpe_stage(spark, more, planted).count() == more.count()


def test_run_gives_back_what_no_stage_reads(spark, planted):
    before = set(P.WRITTEN)
    out = P.run(spark, planted)
    left = [p for p in P.WRITTEN if p not in before]
    assert len(left) == 1 and "pipeline-secrets" in left[0] and out.count() > 0


def slow_shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_whole_run_against_brute_force(spark, planted):
    """Stage by stage in plain Python: languages by the slow fusion, near copies by all pairs, windows and base rules word by word, ids by the library."""
    from tokenizers import Tokenizer

    from quern.llm import bpe_automaton, language_id, secrets
    import test_llm_operators as slow

    out = f"{planted}-small"
    spark.read.parquet(f"{planted}/documents.parquet").filter("doc_id < 70 OR doc_id >= 100000").write.mode("overwrite").parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{planted}/benchmark.parquet").write.mode("overwrite").parquet(f"{out}/benchmark.parquet")
    docs = [r.asDict() for r in spark.read.parquet(f"{out}/documents.parquet").collect()]
    said = lambda t: (m[1].lower() if (m := re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", t or "")) else None)
    judged = slow.slow_language([(d["text"], d["source"], None, said(d["text"])) for d in docs], [(d["text"], d["lang"]) for d in docs])
    docs = [d for d, (lang, p) in zip(docs, judged) if lang != language_id.UND and p >= 0.5 and len(language_id.trigrams((d["text"] or "").encode()))]
    sets = [slow_shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))
    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if len(x & y) >= 0.8 * len(x | y) and root[i] != root[j]:
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root]
    docs = [min((d for d, r in zip(docs, root) if r == k), key=lambda d: d["doc_id"]) for k in sorted(set(root))]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{out}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in items if len((t or "").split()) >= 8]
    docs = [d for d in docs if not any(slow.slow_hits(d["text"], [x])[1] >= 8 for x in long)]
    left = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["found"]] for r in secrets.scan(left, ["doc_id"]).collect()}
    library = Tokenizer.from_file(bpe_automaton.default_path())
    want = {}
    for d in docs:
        assert [s for s in spans[d["doc_id"]] if s[0] != "random"] == slow.slow_base(d["text"])
        text, at, clean = d["text"], 0, ""
        for a, b in merged_runs([(a, b) for _, a, b in spans[d["doc_id"]]]):
            clean, at = clean + text[at:a] + "[SECRET]", b
        want[d["doc_id"]] = library.encode(clean + text[at:], add_special_tokens=False).ids
    got = {r["doc_id"]: r["ids"] for r in P.run(spark, out).collect()}
    assert got == want and len(want) > 30


def merged_runs(spans):
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
