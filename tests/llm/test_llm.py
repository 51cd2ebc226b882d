"""Each operator against a plain version, on sf0.001 and on awkward rows."""

import random
import time
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import blocks, media, mixing, packing, queries, simhash, sketch, substring_dedup, suffix_array, suffix_dedup, token_counts, token_files, tokens, toxicity
from ledgerloom.llm.graph import components

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(params=["documents", "awkward", "nothing"])
def table(request, spark, documents, awkward, awkward_rows, nothing):
    if request.param == "documents":
        return spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), documents
    return (awkward, [r[:2] for r in awkward_rows]) if request.param == "awkward" else (nothing, [])


def test_media(table):
    df, docs = table
    got = media.decode_media(media.encode_texts(df))
    want = []
    for d, t in docs:
        b = (t or "").encode()
        p = b + bytes(media.padded(len(b)) - len(b))
        want.append((d, len(b), len(p), brute.sha(p), __import__("zlib").crc32(p[-64:])))
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    assert got.where("feature is null or media_bytes < payload_bytes").count() == 0


def test_jpeg_of_several_components_and_run_lengths():
    """A 4:2:0 image with its own Huffman tables, coefficients and no restarts, written bit by bit."""
    rng = random.Random(3)
    width, height, bits, dcs, pred = 37, 21, [], [], [0, 0, 0]

    def magnitude(v, size):
        return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    dc_code = {s: f"{s:04b}" for s in range(12)}
    symbols = [0x00, 0xF0, 0x01, 0x12, 0x53, 0x04]
    ac_code = {s: f"{i:03b}" for i, s in enumerate(symbols)}
    for _ in range(3 * 2):
        for part, blocks in ((0, 4), (1, 1), (2, 1)):
            for _ in range(blocks):
                dc = rng.randint(-100, 100)
                diff, pred[part] = dc - pred[part], dc
                size = abs(diff).bit_length()
                bits.append(dc_code[size] + magnitude(diff, size))
                if part == 0:
                    dcs.append(dc)
                k = 1
                while True:
                    s = rng.choice(symbols)
                    if s == 0 or k + (s >> 4) >= 63:
                        bits.append(ac_code[0])
                        break
                    n = s & 15
                    bits.append(ac_code[s] + (magnitude(rng.choice([-1, 1]) * rng.randint(1 << n - 1, (1 << n) - 1), n) if n else ""))
                    k += (s >> 4) + 1
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    scan = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\0")

    def segment(m, body):
        return bytes([255, m]) + (len(body) + 2).to_bytes(2, "big") + body

    dht = b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([0, 0, 6] + [0] * 13) + bytes(symbols)
    data = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([16] * 64)) + segment(0xC0, bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + segment(0xC4, dht) + segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9"
    grey = media.thumbnails([data, b"junk", data[:-2]])
    assert grey[1] is None and grey[2] is None
    full = np.zeros((4, 6), int)
    for i, dc in enumerate(dcs):
        unit, b = divmod(i, 4)
        full[unit // 3 * 2 + b // 2, unit % 3 * 2 + b % 2] = np.clip((dc * 16 + 4 >> 3) + 128, 0, 255)
    assert (grey[0][0] == full[:3, :5]).all()


def test_jpeg_of_separate_scans():
    """Each component in a scan of its own; the luminance, sampled twice, has its blocks row by row."""
    rng = random.Random(9)
    code = {s: f"{s:04b}" for s in range(12)}

    def scan(n):
        bits, dcs, pred = "", [], 0
        for _ in range(n):
            dc = rng.randint(-100, 100)
            diff, pred = dc - pred, dc
            size = abs(diff).bit_length()
            bits += code[size] + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "") + "0"
            dcs.append(dc)
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"), dcs

    def segment(m, body):
        return bytes([255, m]) + (len(body) + 2).to_bytes(2, "big") + body

    dht = segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes([1] + [0] * 15) + b"\0")
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([16] * 64)) + segment(0xC0, bytes([8, 0, 21, 0, 37, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + dht
    blue, grey, red = scan(6), scan(5 * 3), scan(6)  # 37 x 21 samples are 5 x 3 blocks, not the 6 x 4 of whole units
    data = head + b"".join(segment(0xDA, bytes([1, c, 0, 0, 63, 0])) + s for c, (s, _) in ((2, blue), (1, grey), (3, red))) + b"\xff\xd9"
    got = media.thumbnails([data, data + data, data[:-2]])
    want = np.clip((np.array(grey[1]).reshape(3, 5) * 16 + 4 >> 3) + 128, 0, 255)
    assert (got[0][0] == want).all() and len(got[1]) == 2 and (got[1][1] == want).all() and got[2] is None


def test_long_payload_takes_several_frames():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 8200, dtype=np.uint8)
    (data,) = media.encode_payloads(payload, [len(payload)])
    frames = media.thumbnails([data])[0]
    assert len(frames) == 2 and b"".join(f.tobytes() for f in frames) == payload.tobytes()


def test_feature_covers_all_frames(spark):
    """Texts of more than 8191 rows that differ only in the second frame; a plain hash of the whole payload."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij \n") for _ in range(64 * 9000))
    other = text[: 64 * 8192] + text[64 * 8192 :][::-1]
    got = media.decode_media(media.encode_texts(spark.createDataFrame([(1, text), (2, other), (3, text)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert got[0].feature != got[1].feature and got[0].feature == got[2].feature and got[0].height == 9000 and got[0].frames == 2
    for row, t in zip(got, (text, other)):
        grid = [[t.encode()[64 * r + c] for c in range(64)] for r in range(9000)]
        bits = ""
        for i in range(8):
            rows_ = grid[i * 9000 // 8 : (i + 1) * 9000 // 8]
            cells = [[x for r in rows_ for x in r[c * 64 // 9 : (c + 1) * 64 // 9]] for c in range(9)]
            mean = [sum(c) / len(c) for c in cells]
            bits += "".join("01"[a > b] for a, b in zip(mean, mean[1:]))
        assert row.thumbnail_hash == f"{int(bits, 2):016x}"


def test_media_hash_is_of_the_stored_bytes(spark, awkward):
    stored = {r.doc_id: bytes(r.media) for r in media.encode_texts(awkward).collect() if r.doc_id}
    got = {r.doc_id: (r.media_bytes, r.media_sha256) for r in media.decode_media(media.encode_texts(awkward)).collect() if r.doc_id}
    assert got == {d: (len(m), brute.sha(m)) for d, m in stored.items()}


def test_toxicity_learns_and_holds(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = queries.op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    positive, negative = [r[0] for r in held if r[2]], [r[0] for r in held if not r[2]]
    auc = np.mean([(p > n) + (p == n) / 2 for p in positive for n in negative])
    assert len(positive) > 50 and auc > 0.95
    assert sum(r[1] and not r[2] for r in held) <= 0.01 * len(held)


def test_toxicity_awkward(awkward, nothing):
    got = toxicity.toxicity(awkward, nothing.select("doc_id", F.lit(1).alias("toxic")))
    assert got.count() == 17 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where("text = 'you idiot'").first()["predicted"] == 1
    assert got.columns[: len(awkward.columns)] == awkward.columns
    assert toxicity.toxicity(nothing, nothing.select("doc_id", F.lit(1).alias("toxic"))).count() == 0


def kinds(scorer, text):
    return {k: v for k, v in scorer.events(text).items() if v}


def test_grammar_marks_clauses():
    scorer = toxicity.Scorer({"idiot": 3.0, "trott*": 2.0}, toxicity.PRIOR, toxicity.BIAS)
    for text, want in {
        "What an idiot.": {"insult": 3.0},
        "You are an idiot.": {"insult+target": 3.0},
        "He is not an idiot.": {"insult+negated": 3.0},
        "The paper said an idiot won.": {"insult+reported": 3.0},
        "I will kill you": {"threat+target": 1.0},
        "I kill you": {"violence+target": 1.0},
        "They kill time": {"violence+target": 1.0},
        "Some kill time": {"violence": 1.0},
        "We will never kill": {"threat+negated": 1.0},
        "The paper said someone will destroy it": {"threat+reported": 1.0},
        "Trottelige Leute! idiotic. Nicht, kein idiot": {"insult": 2.0, "insult+negated": 3.0},
        "": {},
    }.items():
        assert kinds(scorer, text) == want, text


def test_grammar_reads_whole_clauses():
    """Marks reach as far as the clause does, whatever its length."""
    scorer = toxicity.Scorer({"idiot": 3.0}, toxicity.PRIOR, toxicity.BIAS)
    filler = "word " * 3000
    assert kinds(scorer, f"He said {filler} that you are an idiot") == {"insult+reported": 3.0}
    assert kinds(scorer, f"an idiot {filler} is what you are. {filler}") == {"insult+target": 3.0}
    assert kinds(scorer, f"an idiot {filler} idiot") == {"insult": 6.0}


def test_grammar_against_rules_written_out():
    """Random clauses: what the composed machine marks, and what plain loops over the words say."""
    scorer = toxicity.Scorer({"idiot": 1.0}, toxicity.PRIOR, toxicity.BIAS)
    rng = random.Random(8)
    for _ in range(400):
        words = [rng.choice(["idiot", "kill", "will", "you", "not", "said", "tree", "stone"]) for _ in range(rng.randrange(1, 14))]
        want, intent, negated, reported, target = {}, 0, 0, False, False
        for w in words:
            kind = {"idiot": "insult", "kill": "threat" if intent else "violence"}.get(w)
            if kind:
                mark = "negated" if negated else "reported" if reported else "target" if "you" in words else None
                name = f"{kind}+{mark}" if mark else kind
                want[name] = want.get(name, 0) + 1
            intent = toxicity.REACH if w == "will" else 0 if w == "kill" else max(0, intent - 1)
            negated = toxicity.REACH if w == "not" else max(0, negated - 1)
            reported |= w == "said"
        assert kinds(scorer, " ".join(words)) == want, words


def test_labels_other_than_0_and_1_are_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "toxic")
    odd = docs.limit(20).select("doc_id", F.lit(2).alias("toxic")).union(docs.limit(5).select("doc_id", F.lit(None).cast("int")))
    plain, more = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, labels.union(odd)))
    assert plain == more


def test_tokens_match_the_library(table):
    df, docs = table
    lib = brute.library()
    ids = {}
    want = []
    for d, t in docs:
        n = ids.setdefault(t, lib.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), len(n), len(n) > 2048))
    assert rows(token_counts.token_counts(df, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_count(awkward, awkward_rows, name):
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(public_tokenizers.path(name))
        encode = lambda t: lib.encode(t, add_special_tokens=False).ids
    got = token_counts.token_counts(awkward, public_tokenizers.path(name))
    assert rows(got, "doc_id", "n_tokens") == sorted(((r[0], len(encode(r[1] or ""))) for r in awkward_rows), key=repr)


def test_whole_tokens_are_proved():
    lib = brute.library()
    whole = tokens.whole_tokens(PATH)
    assert len(whole) > 30_000
    assert all(len(lib.encode(s.decode(), add_special_tokens=False).ids) == 1 for s in whole[::97])


def test_token_files(table, spark, tmp_path):
    df, docs = table
    path = str(tmp_path / "tokens")
    token_files.write_token_files(df, path, PATH)
    got = token_files.token_digests(token_files.read_positions(spark, path, "ids"))
    lib, start, want = brute.library(), 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    plan = token_files.read_positions(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_token_files_have_the_layout(spark, documents, tmp_path):
    """Encodings, row groups and page indexes, as the files' footers say."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(documents * 20, "doc_id long, text string"), path, PATH)
    for file in (tmp_path / "tokens").glob("*.parquet"):
        footer = pq.ParquetFile(file).metadata
        for g in range(footer.num_row_groups):
            group = footer.row_group(g)
            assert group.total_byte_size <= 24 << 20
            columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings
            for name in ("doc_id", "n_tokens", "part_start"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and "RLE_DICTIONARY" not in columns[name].encodings
            assert all(c.has_offset_index and c.has_column_index for n, c in columns.items() if n != "ids")


def test_one_doc_id_of_many_rows_is_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    docs = [(7, f"some words of text {i} " * 5) for i in range(100)]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), path, PATH)
    got = token_files.read_positions(spark, path, "ids").orderBy("start").collect()
    lib = brute.library()
    assert [list(r.ids)[:-1] for r in got] == [lib.encode(t, add_special_tokens=False).ids for _, t in docs]
    assert len(list((tmp_path / "tokens").glob("*.parquet"))) > 3


def test_rows_between_blocks_and_shards_stay_few():
    """At 100 TB a row still holds some ten hashes at least, of both rows of the sketch and of byte strings."""
    for size in (1 << 40, 100 << 40):
        for block, shard, found in ((blocks.BLOCK_BYTES, 5 * substring_dedup.SHARD_WINDOWS, size / 6), (suffix_dedup.BLOCK_BYTES, suffix_dedup.SHARD_BYTES, size / 85)):
            count, shards = size / blocks.grown(block, size), size / blocks.grown(shard, size)
            if block == blocks.BLOCK_BYTES:
                assert found / (count * shards) > 10
            else:
                assert found / (count * shards) > 0.02  # intervals are sparse: rows are never more than they
    assert blocks.grown(7, 1 << 30) == 7 and blocks.grown(7, 256 << 30) == 14


def test_equal_rows_are_dealt_to_all_blocks(spark):
    df = spark.createDataFrame([(1, "same " * 50)] * 400, "doc_id long, text string")
    n = [r[1] for r in blocks.Blocks(df, 10_000).rows.groupBy("block").count().collect()]
    assert len(n) > 5 and max(n) < 100


def test_other_steps_are_left_to_the_library(tmp_path):
    """A vocabulary that does not lower-case, or cuts words elsewhere, is counted text by text."""
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "cased.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert tokens.splits_at_space(PATH) and not tokens.splits_at_space(path)
    assert not tokens.splits_at_space(public_tokenizers.path("byte_bpe_50k.json"))


def test_substring_dedup(table):
    df, docs = table
    got = substring_dedup.remove_repeated_windows(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert rows(got, "*") == sorted(((d, *x) for (d, _), x in zip(docs, brute.removed_windows(docs))), key=repr)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 100, 5000):
        for bits in (1, 3, 8, 20, 33, 63):
            values = np.sort(rng.integers(0, 1 << bits, n).astype(np.uint64))
            values[-1] += np.uint64(rng.integers(0, 1 << bits))
            packed = substring_dedup._packed(values)
            assert (substring_dedup._unpacked(packed) == values).all()
    spread = np.sort(rng.integers(0, 1 << 29, 700_000).astype(np.uint64))
    assert len(substring_dedup._packed(spread)) < 1.5 * len(spread)


def test_substring_dedup_over_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WINDOWS", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr("ledgerloom.llm.blocks.Blocks.__init__.__defaults__", (20_000, ()))
    df = spark.createDataFrame(documents, "doc_id long, text string")
    got = substring_dedup.remove_repeated_windows(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s"))
    assert rows(got, "*") == sorted(((d, *x) for (d, _), x in zip(documents, brute.removed_windows(documents))), key=repr)
    for first in (False, True):
        got = suffix_dedup.remove_repeated_bytes(df, keep_first=first).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
        assert rows(got, "*") == sorted(((d, *x) for (d, _), x in zip(documents, brute.removed_bytes(documents, keep_first=first))), key=repr)


def test_suffix_dedup_of_a_hot_phrase(spark, monkeypatch):
    """A phrase in every document, each time in other company, beside a passage and copies that do repeat."""
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9_000)
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    phrase, passage, shared = words(20), words(60), words(30)
    docs = [(i, f"{words(rng.randrange(60))} {phrase} {words(rng.randrange(60))}" + (f" {passage}" if i % 3 == 0 else "") + (f" {phrase} {shared}" if i % 7 == 0 else "")) for i in range(90)]
    docs += [(1000 + i, t) for i, t in docs[:5]] + [(2000, "ab" * 400), (2001, phrase * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for first in (False, True):
        got = suffix_dedup.remove_repeated_bytes(df, keep_first=first).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
        assert rows(got, "*") == sorted(((d, *x) for (d, _), x in zip(docs, brute.removed_bytes(docs, keep_first=first))), key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup(table, keep_first):
    df, docs = table
    docs = [(d, t) for d, t in docs if len(t or "") < 100_000]
    got = suffix_dedup.remove_repeated_bytes(df.where("coalesce(length(text), 0) < 100000"), keep_first=keep_first).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
    assert rows(got, "*") == sorted(((d, *x) for (d, _), x in zip(docs, brute.removed_bytes(docs, keep_first=keep_first))), key=repr)


def test_repeated_text_is_compared_in_stretches():
    """Equal to comparing each pair of suffixes word by word, at a fraction of its time where text repeats."""
    rng = np.random.default_rng(5)
    some = rng.integers(97, 123, 120_000).astype(np.uint8)
    text = np.concatenate([some, rng.integers(97, 123, 5_000).astype(np.uint8), some[:60_000], some[30_000:], some[7:400], np.tile(some[:90], 30)])
    order = suffix_array.suffix_array(text, 200)

    def word_by_word():
        keys = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(208, np.uint8)]), 8)
        todo = np.flatnonzero(np.maximum(order[1:], order[:-1]) + 200 <= len(text)) + 1
        for d in range(0, 200, 8):
            todo = todo[(keys[order[todo] + d] == keys[order[todo - 1] + d]).all(axis=1)]
        return np.isin(np.arange(len(order)), todo)

    def best(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert (suffix_array.reaches(text, order, 200) == word_by_word()).all()
    assert best(lambda: suffix_array.reaches(text, order, 200)) < best(word_by_word) / 3


def test_pieces_and_windows_across_runs(monkeypatch):
    """Hashes and smallest ones do not depend on where the runs that they are worked on in end."""
    rng = np.random.default_rng(6)
    for n in (1, 31, 64, 500, 3000):
        text = rng.integers(0, 256, n).astype(np.uint8)
        whole = suffix_dedup._pieces(text)
        monkeypatch.setattr(suffix_dedup, "RUN", 64)
        assert (suffix_dedup._pieces(text) == whole).all() and len(set(whole.tolist())) == n
        assert (suffix_dedup._pieces(np.concatenate([text, text]))[: max(0, n - 31)] == whole[: max(0, n - 31)]).all()
        for f, plain in ((np.minimum, min), (np.maximum, max)):
            assert suffix_dedup._sliding(f, whole, 169).tolist() == [plain(whole[i : i + 169]) for i in range(n)]
        monkeypatch.undo()


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(200):
        t = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 90))).astype(np.uint8)
        t = np.tile(t, 1 + trial % 3)
        b = t.tobytes()
        assert suffix_array.suffix_array(t, len(t) + 8).tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        wanted = rng.random(len(t)) < 0.4
        some = suffix_array.suffix_array(t, len(t) + 8, wanted)
        assert [i for i in some.tolist() if wanted[i]] == [i for i in sorted(range(len(b)), key=lambda i: b[i:]) if wanted[i]]
        order = suffix_array.suffix_array(t, 11)
        assert [b[i : i + 11] for i in order] == sorted(b[i : i + 11] for i in range(len(b)))
        same = suffix_array.reaches(t, order, 11)
        assert same.tolist() == [False] + [b[i : i + 11] == b[j : j + 11] and max(i, j) + 11 <= len(b) for i, j in zip(order[:-1], order[1:])]


def test_simhash(table):
    df, docs = table
    want = [(d, *x) for (d, _), x in zip(docs, brute.simhash_components(docs))]
    assert rows(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_fingerprint_links_connect_all_within_the_radius(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    signed = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "f long"))
    got = {r[0]: r[1] for r in components(links).collect()}
    a = np.array(signed, np.int64).view(np.uint64)
    parent = list(range(len(a)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2).tolist():
            x, y = find(i), find(i + 1 + j)
            parent[max(x, y)] = min(x, y)
    assert got == {v: signed[find(i)] for i, v in enumerate(signed) if Counter(map(find, range(len(a))))[find(i)] > 1}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (7001, 7000), (7001, 7000)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {7000: 7000, 7001: 7000}


def test_keep_one_of_similar(spark, awkward):
    rng = random.Random(2)
    originals = [" ".join(f"t{rng.randrange(5000)}" for _ in range(300)) for _ in range(40)]
    docs, copies = [(i, t) for i, t in enumerate(originals)], 0
    for i in range(0, 40, 2):
        for k in range(5):
            w = originals[i].split()
            for _ in range(k):
                w[rng.randrange(300)] = "changed"
            docs.append((100 + copies, " ".join(w)))
            copies += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r[0] for r in simhash.keep_one_of_similar(df).collect()}
    assert set(range(40)) <= kept and len(kept) <= 42
    assert simhash.keep_one_of_similar(awkward).columns == awkward.columns
    assert simhash.keep_one_of_similar(awkward.limit(0)).count() == 0


def test_best_fit_keeps_every_capacity():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.integers(1, 1500, 3000), 1000)
    for rule in ("norm", "dot"):
        for docs, cost in ((1000, 1e9), (7, 1e9), (1000, 1_500_000.0)):
            place, offset = packing.best_fit(lengths, 1000, docs, cost, rule)
            total, n, squares = (np.bincount(place, weights=w) for w in (lengths, np.ones(len(lengths)), lengths.astype(float) ** 2))
            assert total.max() <= 1000 and n.max() <= docs and squares.max() <= cost
            by = np.lexsort((offset, place))
            assert all(offset[j] == (offset[i] + lengths[i] if place[i] == place[j] else 0) for i, j in zip(by[:-1], by[1:]))
    place, _ = packing.best_fit(lengths, 1000, 10**6, 1e12)
    assert place.max() + 1 <= 1.01 * lengths.sum() / 1000 + 1


def test_best_fit_chooses_the_best_of_all_open_bins():
    """Each placement replayed by plain loops over all bins, with capacities of documents and attention that bind."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 90, 300)
    whole, weight = (100.0, 4.0, 6000.0), (1.0, 0.05, 0.05)
    lengths = lengths[lengths**2 <= whole[2]]
    for rule in ("norm", "dot"):
        place, offset = packing.best_fit(lengths, 100, 4, 6000.0, rule)
        left, bound = {}, set()
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = float(lengths[i])
            need = (n, 1.0, n * n)
            score = {}
            for b, rest in left.items():
                if all(r >= x for r, x in zip(rest, need)):
                    if rule == "dot":
                        score[b] = -sum(w * x / c * r / c for w, x, r, c in zip(weight, need, rest, whole))
                    else:
                        score[b] = sum(w * ((r - x) / c) ** 2 for w, x, r, c in zip(weight, need, rest, whole))
                elif rest[0] >= n:
                    bound.add("documents" if rest[1] < 1 else "attention")
            b = int(place[i])
            assert (b not in left) == (not score) and (not score or score[b] <= min(score.values()) + 1e-9)
            rest = left.get(b, whole)
            assert offset[i] == whole[0] - rest[0]
            left[b] = tuple(r - x for r, x in zip(rest, need))
        assert bound == {"documents", "attention"}


def test_short_pieces_are_dealt_to_more_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    items = spark.createDataFrame([(i, 0, 0, 1, 0) for i in range(1000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items).collect()
    assert len({r.sequence_id >> 32 for r in got}) == 10 and len({(r.sequence_id, r.offset) for r in got}) == 1000


def test_packing(table):
    df, docs = table
    got = packing.pack(packing.pieces(df, PATH, 512), 512, 512, 512.0**2, group_tokens=40_000).collect()
    lib, want = brute.library(), []
    for d, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, s, len(ids[s : s + 512]), brute.crc(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(bins) <= 1.02 * total / 512 + 3


def test_mixing(table):
    df, docs = table
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.taken_words(sized).collect()
    source = [(r[0], r[1], r[2]) for r in sized.collect()]
    assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(((a, c) for a, _, c in source), key=repr)
    total = Counter()
    for _, s, n in source:
        total[s] += n
    target = mixing.shares(list(total.items()))
    assert abs(sum(target.values()) - sum(total.values())) < 1e-6 * max(1, sum(total.values()))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size, round(r.target, 6)] += r.taken
    want = Counter()
    for s, t in target.items():
        want[total[s], round(t, 6)] += round(t)
    assert all(abs(v - want[k]) <= max(3, 0.01 * want[k]) for k, v in taken.items())
    plain = brute.golden_mix(source)
    assert sorted(((r.doc_id, r["size"], r.taken, r.slot) for r in got), key=repr) == sorted(plain, key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(sized).collect()), key=repr)


def test_mixed_documents(spark, awkward):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.mixed(df)
    assert out.columns == df.columns and max(Counter(r[0] for r in out.select("doc_id").collect()).values()) <= 3
    assert mixing.mixed(awkward).columns == awkward.columns


def test_mix_comes_from_the_schedule(spark, monkeypatch):
    """With another schedule, the mix is another: which documents are taken, how much of each source, and where."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sized = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    before = sorted(map(tuple, mixing.taken_words(sized).collect()), key=repr)
    monkeypatch.setattr(mixing, "GOLDEN", (1 << 63) + 1)
    after = sorted(map(tuple, mixing.taken_words(sized).collect()), key=repr)
    assert [r[4] for r in before] != [r[4] for r in after] and [r[5] for r in before] != [r[5] for r in after]


def test_mix_does_not_depend_on_partitions(spark, awkward):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for table in (df, awkward.union(awkward.where("doc_id = 1 or doc_id is null")), df.withColumn("source", F.lit("one"))):
        one, other = (sorted((tuple(r) for r in mixing.mixed(table.repartition(n)).collect()), key=repr) for n in (1, 7))
        assert one == other


def test_targets_far_apart_have_schedules_of_their_own(spark):
    docs = [(i, "big" if i < 900 else "small" if i < 950 else None, 400 if i < 900 else 1) for i in range(990)]
    got = {}
    for r in mixing.taken_words(spark.createDataFrame(docs, "doc_id long, source string, size long")).collect():
        got.setdefault(r.target, []).append(r.taken)
    assert len(mixing.tiers({"big": 360_000.0, "small": 150.0, None: 150.0})) == 2
    assert all(abs(sum(t) - target) <= max(3, 0.01 * target) for target, t in got.items())


def test_shares_stop_at_the_most():
    got = mixing.shares([("a", 10), ("b", 1000), (None, 50)])
    assert got["a"] == 30 and got[None] == 150 and got["b"] == 880


def test_sketches_with_the_next(table):
    df, docs = table
    got = sketch.neighbour_likeness(df).collect()
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = (set(sketch.shingle_hashes(x.encode()).tolist()) for x in (t, edited, u))
        want.append((d, len(t), brute.sha(edited.encode()), *(len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c))))
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    exact = {(w[0], w[2]): w[3:] for w in want}
    error = [abs(x - y) for r in got for x, y in zip((r.near_edited, r.near_next), exact[r[0], r[2]])]
    assert np.mean(error or [0]) < 0.06
    texts = {(d, brute.sha((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode())): t for (d, t), (_, u) in zip([(d, t or "") for d, t in order], [(d, t or "") for d, t in order[1:] + order[:1]])}
    of_text = {}
    for r in got:
        text = texts[r.doc_id, r.edited_sha256]
        plain = sorted(h for h in sketch.shingle_hashes(text.encode()).tolist() if h < 2**64 // sketch.FRACTION)
        assert sketch.from_text(r.fingerprint)[2:].tolist() == plain and of_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_sketches_of_one_doc_id_over_many_ranges(spark, monkeypatch):
    """All documents of one doc_id, in more ranges than one: each is followed by the next of the input."""
    monkeypatch.setattr(sketch, "RANGE_BYTES", 300)
    docs = [(d, f"text {i} of {d} " + " ".join(f"w{i}x{j}" for j in range(8))) for d in (7, None, 9) for i in range(40)]
    got = {r.edited_sha256 for r in sketch.neighbour_likeness(spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)).collect()}
    order = docs[80:] + docs[:80]
    want = {brute.sha((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()) for (_, t), (_, u) in zip(order, order[1:] + order[:1])}
    assert got == want and len(want) == 120


def test_sketch_merge_and_containment():
    a, b = (" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 4000), ("b", 400)))
    x, y = sketch.shingle_hashes(f"{a} {b}".encode()), sketch.shingle_hashes(b.encode())
    near, inside, around = sketch.likeness(sketch.fingerprint(y), sketch.fingerprint(x))
    assert inside == 1 and around < 0.2 and near < 0.2
    assert (sketch.merge(sketch.sketch(x), sketch.sketch(y)) == sketch.sketch(np.union1d(x, y))).all()
    assert (sketch.from_text(sketch.as_text(sketch.fingerprint(x))) == sketch.fingerprint(x)).all()


def test_sketches_of_texts_too_short_to_retain_anything():
    few = [sketch.fingerprint(sketch.shingle_hashes(f"text {i}".encode())) for i in range(40)]
    bare = [f for f in few if len(f) == 2]
    assert len(bare) > 10 and sketch.likeness(bare[0], bare[0])[0] == 1 and sketch.likeness(bare[0], bare[1])[0] == 0


def test_queries_run_on_whole_tables(spark):
    for name, query in queries.queries().items():
        assert query(spark, "/root/testdata/sf0.001").count() >= 200, name


def test_known_parts_are_not_learned_again():
    encoder = tokens.PartEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [b"The cat sat, the cat.", b"", b"cat <|end|> sat"]
    first = encoder.ids(texts)
    encoder._learn = None  # it would fail
    assert encoder.ids(texts) == first == [encoder.words.alone(t.decode()).tobytes() for t in texts]
