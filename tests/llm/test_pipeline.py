"""The stages of the pipeline, each against a plain version over what the one before kept."""

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, queries, resemblance, simhash, sketch

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas().astype(object).where(lambda x: x.notna(), None), stage(spark, docs, SMALL).schema)
        out.append(docs.cache())
    return out


def texts(df):
    return sorted((r[0], r[1] or "") for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    assert all(k.columns == kept[0].columns for k in kept[1:5])


def test_toxic_documents_go(spark, kept):
    rejected = {r[0] for r in queries.op2_toxicity(spark, SMALL).where("predicted = 1").collect()}
    assert texts(kept[1]) == [x for x in texts(kept[0]) if x[0] not in rejected]


def test_one_of_each_near_copy_stays(kept):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    before, after = texts(kept[1]), {d for d, _ in texts(kept[2])}
    sets = {d: shingles(t) for d, t in before}
    alike = {d: [e for e in sets if e != d and len(sets[d] & sets[e]) >= 0.6 * len(sets[d] | sets[e])] for d in sets}
    for d in sets:
        if d not in after:
            assert alike[d], "a document without near copies stays"
        elif surely := [e for e in alike[d] if len(sets[d] & sets[e]) >= 0.9 * len(sets[d] | sets[e])]:
            assert not after & set(surely)


def test_repeated_passages_are_cut(kept):
    before = texts(kept[2])
    want = []
    for (d, t), (n, removed, _, digest) in zip(before, brute.removed_bytes(before, keep_first=True)):
        want.append((d, removed, digest))
    got = {d: t for d, t in texts(kept[3])}
    for (d, removed, digest), (_, t) in zip(want, before):
        if not removed:
            assert got[d] == t
        elif d in got:
            assert len(t.encode()) - removed - 8 <= len(got[d].encode()) <= len(t.encode()) - removed
    assert {d for d, removed, _ in want if not removed} <= set(got)


def test_mix_and_packing(kept):
    n = Counter(r[0] for r in kept[4].select("doc_id").collect())
    assert set(n) <= {d for d, _ in texts(kept[3])} and max(n.values()) <= 3
    sizes = [(r[0], r[1]) for r in kept[3].groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()]
    words = {r[0]: r[1] for r in kept[4].groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    target = mixing.shares(sizes)
    assert abs(sum(words.values()) - sum(target.values())) < 0.3 * sum(target.values())
    lib = brute.library()
    want = Counter()
    for d, t in texts(kept[4]):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want.update((d, s // 4096, brute.crc(ids[s : s + 4096])) for s in range(0, len(ids), 4096))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in kept[5].collect()) == want


def test_near_copies_and_toxic_documents_planted(spark, tmp_path):
    """Exact and near copies, toxic documents and clean ones, among others of the same kind."""
    folder = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300")
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(6))
    clean = [" ".join(word() for _ in range(250)) for _ in range(30)]
    near = [" ".join(w if k % 120 else "other" for k, w in enumerate(t.split(), 1)) for t in clean[:10]]
    toxic = [" ".join([*t.split()[:40], "idiot", *t.split()[41:60], "moron"]) + "." for t in clean[20:]]
    rows = [(10_000 + i, t) for i, t in enumerate(clean[:20])] + [(20_000 + i, t) for i, t in enumerate(near)] + [(30_000 + i, t) for i, t in enumerate(toxic)] + [(40_000 + i, t) for i, t in enumerate(clean[10:15])]
    docs = base.unionByName(spark.createDataFrame([(d, t, "en", "src1", len(t)) for d, t in rows], base.schema))
    first = corpus_pipeline.reject_toxic(spark, docs, folder)
    assert not {d for d, _ in texts(first)} & set(range(30_000, 30_010))
    left = {d for d, _ in texts(corpus_pipeline.drop_near_copies(spark, first, folder))}
    assert set(range(10_000, 10_020)) <= left and not left & {*range(20_000, 20_010), *range(40_000, 40_005)}
    assert simhash.keep_one_of_similar(docs).columns == docs.columns


def test_stages_take_awkward_tables(spark, awkward_rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, kept binary, score int, _near0 string, _mix_key int, `_score` int"
    rows = [(d, t, None, s, None, None, 1, "x", 3, 4) for d, t, _, s, *_ in awkward_rows if len(t or "") < 100_000]
    for table in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == table.columns and docs.dtypes == table.dtypes
            docs = spark.createDataFrame(docs.collect(), table.schema)
        packed = corpus_pipeline.pack_sequences(spark, docs, SMALL)
        assert packed.count() >= docs.count()
    kept = [r[0] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, names), SMALL).select("text").collect()]
    assert len([t for t in kept if not (t or "").split()]) == 1 and kept.count("the quick brown fox") == 1


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_in_order(docs, least=0.8):
    """Plain version: by ascending doc_id, each document stays that resembles none that stays."""
    stay = []
    for d, t in sorted(docs):
        s = shingle_set(t)
        if not any(len(s & x) >= least * len(s | x) - 1e-9 for _, x in stay):
            stay.append((d, s))
    return {d for d, _ in stay}


def stay_of(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r[0] for r in simhash.keep_one_of_similar(df).collect()}


def words_of(rng, n):
    return ["".join(rng.choice("aeiourstlnm") for _ in range(7)) for _ in range(n)]


def test_no_document_is_lost_below_the_resemblance(spark):
    """A line that documents repeat is no resemblance, nor is a template, nor a chain of small steps."""
    rng = random.Random(31)
    line, template = words_of(rng, 10), words_of(rng, 300)
    docs = [(i, " ".join(line * 50 + words_of(rng, 300))) for i in range(30)]
    docs += [(100 + i, " ".join(template + words_of(rng, 130))) for i in range(30)]
    chain = words_of(rng, 300)
    for i in range(12):
        docs.append((200 + i, " ".join(chain)))
        chain[i * 25 : i * 25 + 25] = words_of(rng, 25)
    docs += [(300, docs[0][1]), (301, docs[30][1] + " tail")]
    got, want = stay_of(spark, docs), kept_in_order(docs)
    assert want >= {*range(30), *range(100, 130)} and 2 < len(want & set(range(200, 212))) < 12
    assert got == want


def test_every_near_copy_is_found_among_documents_of_a_template(spark):
    """Crowds that share half or more of their shingles hide no pair; a crowd of near copies leaves those that differ."""
    rng = random.Random(32)
    template, docs = words_of(rng, 200), []
    for i in range(250):
        w = template + words_of(rng, 100)
        docs.append((i, " ".join(w)))
        if i < 60:
            at = rng.randrange(200, 280)
            docs.append((1000 + i, " ".join(w[:at] + words_of(rng, 20) + w[at + 20 :])))
    base = words_of(rng, 200)
    for i in range(250):
        n = rng.randrange(1, 40)
        docs.append((2000 + i, " ".join(base[:150] + words_of(rng, n) + base[150 + n :])))
    got = stay_of(spark, docs)
    assert got == kept_in_order(docs)
    assert set(range(250)) <= got and not got & set(range(1000, 1060)) and 1 < len(got & set(range(2000, 2250))) < 250


def test_no_pair_is_missed_at_the_limit(spark):
    """Pairs at 0.8 to 0.85, against brute force: all of them are found, and none at 0.75 to 0.8."""
    rng = random.Random(33)
    docs, alike = [], {}
    for i in range(240):
        w = words_of(rng, rng.randrange(60, 500))
        n = round(len(w) * rng.uniform(0.07, 0.14))
        docs += [(i, " ".join(w)), (1000 + i, " ".join(w[: len(w) // 2] + words_of(rng, n) + w[len(w) // 2 + n :]))]
        a, b = shingle_set(docs[-2][1]), shingle_set(docs[-1][1])
        alike[i] = len(a & b) / len(a | b)
    five = [f"q{i}" for i in range(13)]
    docs += [(5000, " ".join(five[:12])), (5001, " ".join(five)), (5002, " ".join(five[:8])), (5003, " ".join(five[:9]))]
    got = stay_of(spark, docs)
    assert sum(0.8 <= x < 0.85 for x in alike.values()) > 40 and sum(0.75 <= x < 0.8 for x in alike.values()) > 40
    assert {i for i in alike if 1000 + i not in got} == {i for i, x in alike.items() if x >= 0.8}
    assert got == kept_in_order(docs)


def near_copies_of(seed):
    """Texts and copies of each with some words changed, of resemblance 0.8 to 1, and small sets."""
    rng, docs = random.Random(seed), []
    for i in range(120):
        w = words_of(rng, rng.randrange(80, 400))
        n = max(1, round(len(w) * rng.uniform(0, 0.08)))
        at = rng.randrange(len(w) - n)
        docs += [(i, " ".join(w)), (1000 + i, " ".join(w[:at] + words_of(rng, n) + w[at + n :]))]
    docs += [(3000 + i, " ".join(f"s{k}" for k in range(i))) for i in range(12)]
    return docs + [(4000, None), (4001, docs[0][1]), (4002, docs[1][1])]


def plain_simhash(hashes, n_words):
    """Words of 64 bits: the k-th of the k-th hashes of all shingles."""
    out, m = [], 2**64 - 1
    for k in range(n_words):
        each = []
        for h in hashes:
            if k:
                h = (h + k * 0x9E3779B97F4A7C15) & m
                h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & m
                h = (h ^ (h >> 27)) * 0x94D049BB133111EB & m
                h ^= h >> 31
            each.append(h)
        out.append("".join("1" if 2 * sum(h >> b & 1 for h in each) > len(each) else "0" for b in range(63, -1, -1)))
    return out


def test_simhash_links_go_to_the_least_of_a_band(spark):
    """Fingerprints of sets, their bands and links, against a plain version."""
    docs = [(d, t or "") for d, t in [*near_copies_of(41)[:60], *near_copies_of(41)[240:]]] + [(9000, "a " * 700), (9001, " ".join(f"z{i}" for i in range(700)))]
    found = {r.key: bytes(r.bits) for r in resemblance.set_digests(spark.createDataFrame(docs, "key long, text string"), 5).collect()}
    bits = {d: "".join(plain_simhash([int(h) for h in sketch.shingle_hashes(t.encode(), 5)], resemblance.N_WORDS)) for d, t in docs}
    assert {d: "".join(f"{x:08b}" for x in b) for d, b in found.items()} == bits

    width, least, want = 16, {}, set()
    for d in sorted(bits):
        for at in range(0, 512, width):
            b = least.setdefault((at, bits[d][at : at + width]), d)
            if b != d and sum(x != y for x, y in zip(bits[d][:64], bits[b][:64])) <= simhash.APART:
                want.add((d, b))
    nodes = spark.createDataFrame([(d, bytearray(b)) for d, b in found.items()], "node long, bits binary")
    assert {tuple(r) for r in simhash.linked_to_least(nodes).collect()} == want and len(want) > 5
    assert simhash.linked_to_least(nodes.limit(0)).count() == 0


def test_simhash_decides_near_copies(spark, monkeypatch):
    """What SimHash links and the exact check confirms goes by that, and is compared with nothing more."""
    asked, found, real = [], [], resemblance.resembling

    def spy(pairs, *rest):
        out = real(pairs, *rest)
        asked.append({tuple(r) for r in pairs.collect()})
        found.append({tuple(r) for r in out.collect()})
        return out

    monkeypatch.setattr(resemblance, "resembling", spy)
    monkeypatch.setattr(simhash, "resembling", spy)
    docs = near_copies_of(42)[:160]
    got = stay_of(spark, docs)
    assert got == kept_in_order(docs)
    near = {d for d, _ in docs if d not in got}
    decided, searched = found[0], set().union(*asked[1:])
    assert len(near) > 50 and len(decided) >= 0.7 * len(near) and not decided & searched


def test_near_copies_do_not_depend_on_fingerprints(spark, monkeypatch):
    """No links, or links between any texts, leave the same texts: what SimHash does not settle is searched."""
    docs = near_copies_of(43)
    want = kept_in_order([(d, t or "") for d, t in docs])
    for pairs in ([], [(a, b) for a in range(0, 60) for b in range(0, a, 7)]):
        monkeypatch.setattr(simhash, "linked_to_least", lambda nodes, pairs=pairs: spark.createDataFrame(pairs, "a long, b long"))
        assert stay_of(spark, docs) == want
