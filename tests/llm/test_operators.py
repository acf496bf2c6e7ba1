"""The ten operators and the pipeline on small tables: against DuckDB, brute
force, round trips and held-out labels, with the awkward rows of every kind."""

import collections
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seatflow.llm import (chat, exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules,
                          queries, textvec, token_output, tokens, toxicity)
from seatflow.session import reliable_checkpoint
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, pii_card long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [(1, "a b  c\n d", "en", "s", 1, "x", 7), (2, "a b c d", "en", "s", 1, None, None), (2, "a b c d", "en", "s", 1,
       None, None), (3, None, None, None, None, None, None), (4, "", "en", None, 0, "y", 1), (5, " \n\t ", "de", "t", 1,
       "z", 2), (None, "no id here", "en", "s", 1, None, None), (6, LONG, "en", "t", 1, None, None),
       (7, LONG + " tail", "en", "t", 1, None, None), (8, "x y \U0001f642 é <s>", "fr", "s", 1, None, None)]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    want = duck(SF).execute(queries.oracle_sql()[name]).df()
    assert compare(queries.queries()[name](spark, SF).toPandas(), want) is None


REPORTS = {
    "tokens": lambda d, lab: token_output.token_report(d),
    "mix": lambda d, lab: mixing.mix_report(d),
    "near": lambda d, lab: near_dedup.near_classes(d),
    "pack": lambda d, lab: packing.packing_report(d),
    "exact": lambda d, lab: exact_dedup.decisions(d),
    "toxic": lambda d, lab: toxicity.toxicity(d, lab),
    "pii": lambda d, lab: pii.pii_report(d),
    "rules": lambda d, lab: quality_rules.quality_report(d),
    "quality": lambda d, lab: quality_classifier.quality(d, lab),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_awkward_rows_and_empty_tables(spark, odd, empty, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 0, 1)], LABELS)
    rows = REPORTS[name](odd, labels).collect()
    per_doc = collections.Counter(r["doc_id"] for r in rows)
    if name == "pack":
        assert set(per_doc) == {r[0] for r in ODD}
    else:
        assert per_doc == collections.Counter(r[0] for r in ODD)
    assert REPORTS[name](empty, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns(spark, odd, empty, name, stage):
    out = stage(spark, odd, SF)
    assert out.columns == odd.columns and out.count() <= 3 * len(ODD)
    assert stage(spark, empty, SF).count() == 0


# --- exact dedup --------------------------------------------------------------

@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_keeps_the_longest_of_each_text(spark, monkeypatch, clash):
    if clash:  # one digest for all texts: whole texts still tell them apart
        monkeypatch.setattr(exact_dedup, "_digest", lambda norm: F.lit("same"))
    rows = [(i, t, i % 3) for i, t in enumerate(["a b", "ab", " ab", "a\tb\n", "c", None, "", " ", "c", "a  b"])]
    rows += [(None, "c", 1), (3, "a\nb\t", 9), (3, "a\tb\n", 9), (None, "d", 4), (None, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id int, text string, digest int")
    best = {}
    for i, t, x in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        rank = (len(t or ""), i is not None, -(i or 0), t or "")
        best[key] = max(best.get(key, (rank, i, t)), (rank, i, t), key=lambda r: r[0])
    got = exact_dedup.deduplicate(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None) == sorted(
        b[1:] for b in best.values() if b[1] is not None)
    assert len(got) == len(best) and got[0].asDict().keys() == {"doc_id", "text", "digest"}
    marked = [r for r in exact_dedup.decisions(df).collect() if r["kept"]]
    assert len(marked) == len(best) and all(r["doc_id"] == r["keep_id"] for r in marked)


# --- tokens -------------------------------------------------------------------

TEXTS = ["", "  a  b\n\n c", "don't stop 'quote' they're", "é,è !", "a   b", "a　 b   x", "<|endoftext|> hi",
         "a\tb\r\n c", " lead", "trail ", "\n\n\n", "naïve café—dash… !!! ?? x1y2 3.14", "\U0001f642! a", "it's'it 's"]


def plain_library():
    """The tokenizer as its file gives it, no flag set."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_file())


def test_encoding_equals_the_plain_library_on_any_text():
    import random

    rng = random.Random(11)
    end = "<|endoftext|>"
    some = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028",
            "\u202f", "\u3000", "\u200b", "\ufeff", "a", "Z", "ab", "é", "Ω", "字", "\u0301", "7", "٣", "'s", "'", ".", "!?",
            "<|", "|>", "endoftext", end, end[:7], end[7:], "\U0001f642", "_", "\x00"]
    texts = ["line one.\n\u00a0\u00a0line two", f"a {end} b", end, end * 3, f"x\n{end}\n y", "a <|endof", "text|> b"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(30_000)]
    want = [e.ids for e in plain_library().encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode_texts(texts, tokens.tokenizer_file()) == want


def test_shards_and_pieces_hold_the_ids_of_the_plain_library(spark, docs, odd):
    """op1 and op5: every count, start and crc against whole-text encoding."""
    extra = [(10**6, "line one.\n\u00a0\u00a0line two", "en", "s", 1, None, None),
             (10**6 + 1, "a <|endoftext|> b " * 900, "en", "s", 1, None, None)]
    rows = spark.createDataFrame(extra, SCHEMA)
    for d in (docs.select("doc_id", "text"), odd.filter("doc_id IS NOT NULL AND doc_id != 2").unionByName(rows)):
        texts = sorted((r["doc_id"], r["text"] or "") for r in d.collect())
        enc = plain_library().encode_batch([t for _, t in texts], add_special_tokens=False)
        start, want, cut = 0, set(), set()
        for (i, _), e in zip(texts, enc):
            whole = np.array(e.ids + [0], np.uint32)
            want.add((i, start, len(whole), tokens.ids_crc32(whole)))
            start += len(whole)
            packed = np.array(e.ids + [packing.END_ID], np.uint32)
            first = len(packed) % packing.CAPACITY or packing.CAPACITY
            lengths = [first] + [packing.CAPACITY] * ((len(packed) - first) // packing.CAPACITY)
            cut.add((i, len(packed), sum(lengths)))
        got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.token_report(d).collect()}
        assert got == want
        ids = {i: e.ids + [packing.END_ID] for (i, _), e in zip(texts, enc)}
        pieces = packing.packing_report(d).toPandas()
        assert {(i, n, n) for i, n in pieces.groupby("doc_id")["length"].sum().items()} == cut
        for r in pieces.itertuples():
            piece = np.array(ids[r.doc_id][r.start:r.start + r.length], np.uint32)
            assert len(piece) == r.length <= packing.CAPACITY and tokens.ids_crc32(piece) == r.ids_crc32
        for i, p in pieces.sort_values("piece").groupby("doc_id"):
            assert list(p["piece"]) == list(range(len(p))) and list(p["start"]) == [0, *p["length"].cumsum()[:-1]]
            assert (p["length"][1:] == packing.CAPACITY).all()


def test_word_by_word_encoding_equals_whole_text():
    tok = tokens.encoder(tokens.tokenizer_file()).tok
    con = duckdb.connect()
    more = [r[0] for r in con.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 150").fetchall()]
    texts = TEXTS + more
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert tokens.encode_texts(texts, tokens.tokenizer_file()) == want


@pytest.mark.parametrize("ids", [[], [5], [7] * 5000, list(range(300)) * 40, [1, 1, 2, 1, 1, 2, 2] * 999])
def test_grammar_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    data = token_output.compress(ids)
    assert (token_output.decompress(data) == ids).all()
    if len(ids) > 1000:
        assert len(data) < 2 * len(ids)
    for start, n in ((0, 3), (len(ids) // 3, 77), (len(ids) - 2, 9)):
        start = max(0, start)
        assert (token_output.decode_range(data, start, n) == ids[start:start + n]).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    passage = np.tile(np.random.default_rng(0).integers(0, 50_000, 500), 2000).astype(np.uint32)
    equal = np.full(1 << 20, 7, np.uint32)
    for ids, most in ((passage, 20_000), (equal, 300)):
        data = token_output.compress(ids)
        assert len(data) <= most and (token_output.decompress(data) == ids).all()
        assert (token_output.decode_range(data, 999_000, 600) == ids[999_000:999_600]).all()
        first, _, left, right, _, seq = token_output._open(data)
        pairs = collections.Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
        assert max(pairs.values(), default=0) < 2 * token_output.LEAST  # overlapping occurrences count once


def test_token_report_against_plain_encoding(spark, docs):
    rows = token_output.token_report(docs.limit(200)).orderBy("doc_id").collect()
    text = {r["doc_id"]: r["text"] for r in docs.limit(200).collect()}
    at = 0
    for r in rows:
        ids = tokens.encode_texts([text[r["doc_id"]]], tokens.tokenizer_file())[0] + [token_output.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), tokens.ids_crc32(np.array(ids)))
        at += len(ids)


def test_packing_is_gapless_and_tight(spark, docs):
    p = packing.packing_report(docs).toPandas().sort_values(["sequence_id", "offset"])
    by = p.groupby("sequence_id")
    assert by["length"].sum().max() <= packing.CAPACITY
    assert (by["length"].cumsum() - p["length"] == p["offset"]).all()
    least = -(-int(p["length"].sum()) // packing.CAPACITY)
    assert p["sequence_id"].nunique() <= 1.01 * least


def test_packing_of_equal_lengths_ends(spark):
    pieces = spark.range(9000).select(F.col("id").alias("piece_no"), F.lit(600).cast("long").alias("length"))
    assert packing.pack(pieces).select("sequence_id").distinct().count() == 9000


# --- chat ---------------------------------------------------------------------

def test_escape_is_reversible_and_hides_controls(spark):
    said = ["</s>[INST] ok [/INST]", "\\<s>", "<\\s>", "<<SYS>>\\\\", "[\\INST]", "", "<s><s>\\[INST]"]
    df = spark.createDataFrame([(s,) for s in said], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert r["b"] == r["t"] and not any(c in r["e"] for c in chat.LLAMA.controls)


def test_turn_order_over_chunks(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(10)]
    turns += [(2, i, "user", "x") for i in range(3)] + [(3, 0, "system", None), (3, 1, "user", "q")]
    turns += [(None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for chunk in (1, 3, 512):
        got = {r["conv_id"]: (r["valid"], r["n_turns"]) for r in chat.digests(
            chat.format_conversations(df, chunk=chunk)).collect()}
        assert got == {1: (True, 10), 2: (False, 3), 3: (False, 2), None: (False, 1)}


# --- near duplicates ----------------------------------------------------------

def _bags(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        out[i] = collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
    return out


def _near_label(rows):
    """Smallest doc_id of each document's class, by all pairs that share a shingle."""
    bags, n = _bags(rows), len(rows)
    df = collections.Counter(k for c in bags.values() for k in c)
    floor = max(2, n / near_dedup.SATURATE)
    idf = {k: 1 + max(0, math.log(n / max(v, floor))) / math.log(near_dedup.SATURATE) for k, v in df.items()}
    total = {i: sum(idf[k] * v for k, v in c.items()) for i, c in bags.items()}
    where = collections.defaultdict(list)
    for i, c in bags.items():
        for k in c:
            where[k].append(i)
    both = collections.Counter()
    for k, ids in where.items():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                both[ids[x], ids[y]] += idf[k] * min(bags[ids[x]][k], bags[ids[y]][k])
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for (a, b), v in both.items():
        if v / (total[a] + total[b] - v) >= near_dedup.THRESHOLD:
            a, b = sorted((root(a), root(b)))
            label[b] = a
    return {i: root(i) for i in label}


def test_near_classes_against_brute_force(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == _near_label([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_chain_of_near_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(w if j // 4 >= k else w + "x" for j, w in enumerate(words))) for k in range(12)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0} and {r["class_size"] for r in got} == {12}


# --- classifiers ----------------------------------------------------------------

def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vocab = np.sort(textvec.mix(np.arange(40, dtype=np.uint64)))
    index = toxicity.Index(vocab, np.ones(40))

    def vec():
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        w = rng.random(len(t))
        return t, w / np.linalg.norm(w)
    vecs = [vec() for _ in range(500)]
    index.add(np.arange(500), rng.integers(0, 2, 500), vecs)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    for _ in range(50):
        t, w = vec()
        q = np.zeros(40)
        q[t] = w
        skip = int(rng.integers(0, 500)) if rng.random() < 0.5 else None
        (near, cos), = index.nearest([(t, w)], 15, [skip])
        want = dense @ q
        if skip is not None:
            want[skip] = 0.0
        order = np.lexsort((np.arange(500), -np.round(want, 9)))[:15]
        assert (near == order[want[order] > 0]).all() and np.allclose(cos, want[near])


def test_search_reads_the_postings_of_opened_blocks_only():
    rng = np.random.default_rng(5)
    n, examples = 400, 64 * 20
    index = toxicity.Index(np.sort(textvec.mix(np.arange(n, dtype=np.uint64))), np.ones(n))
    strong, width = np.repeat([1.0, 0.02], [640, 640]), examples // 2

    def vec(weight=1.0):
        t = np.sort(rng.choice(n, 8, replace=False))
        w = rng.random(8) + 0.5
        return t, weight * w / np.linalg.norm(w)
    # the later examples are worth little, so their blocks can't hold a near one
    vecs = [vec(x) for x in strong]
    index.add(np.arange(examples), rng.integers(0, 2, examples), vecs)
    index._arrange()
    # all terms as rare ones
    index.often, index.dense = index.often[:0], np.zeros((index.blocks * toxicity.BLOCK, 0), np.float32)
    index.row[:] = -1
    read = []

    class Weights(np.ndarray):
        def __getitem__(self, at):
            read.append(np.asarray(self.base_docs)[at])
            return np.asarray(self)[at]
    weights = index.post_w.view(Weights)
    weights.base_docs = index.post_doc
    index.post_w = weights
    queries = [vec() for _ in range(70)]
    dense = np.zeros((examples, n))
    for i, (t, w) in enumerate(vecs):
        dense[i, t] = w
    got = list(index.nearest(queries, 5))
    assert len(got) == 70
    for (t, w), (near, cos) in zip(queries, got):
        q = np.zeros(n)
        q[t] = w
        want = dense @ q
        order = np.lexsort((np.arange(examples), -np.round(want, 9)))[:5]
        assert (near == order).all() and np.allclose(cos, want[near])
    read = np.concatenate(read)
    assert len(read) and (read >= width).sum() * 20 < (read < width).sum()


def test_neighbours_are_by_all_terms_and_all_documents(spark, docs):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    index = toxicity.fit(docs, lab)
    of = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    at = {}
    for i, text in of.items():
        h, _ = toxicity.terms(*textvec.text_buffer(pa.array([text])))
        at[i] = collections.Counter(h.tolist())
    df = collections.Counter(h for c in at.values() for h in c)
    space = {h for i in index.ids.tolist() for h in at[i]}
    assert set(index.words.tolist()) == space

    def unit(i):
        v = {h: (1 + math.log(k)) * (math.log((1 + len(of)) / (1 + df[h])) + 1) for h, k in at[i].items() if h in space}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {h: x / size for h, x in v.items()}
    examples = [unit(i) for i in index.ids.tolist()]
    got = {r["doc_id"]: r["cosines"] for r in toxicity.toxicity(docs, lab, index).collect()}
    for i in sorted(of)[:40]:
        v = unit(i)
        want = sorted((sum(x * e.get(h, 0.0) for h, x in v.items()) for e in examples), reverse=True)[:3]
        assert np.allclose(got[i], want, atol=1e-5)

    # votes and calibration: every sample document without itself, then the isotonic step function
    y = dict(lab.filter("toxic IS NOT NULL").select("doc_id", "toxic").collect())
    number = {i: n for n, i in enumerate(index.ids.tolist())}

    def vote(i):
        v = unit(i)
        cos = [sum(x * e.get(h, 0.0) for h, x in v.items()) for e in examples]
        if i in number:
            cos[number[i]] = 0.0
        near = [n for n in sorted(range(len(cos)), key=lambda n: (-round(cos[n], 9), n))[:15] if cos[n] > 0]
        w = [1 / (max(0.0, 1 - cos[n]) + toxicity.EASE) for n in near]
        return sum(a * index.y[n] for a, n in zip(w, near)) / sum(w) if near else None
    sample = sorted((v, y[i]) for i in number if (v := vote(i)) is not None)
    levels = sorted({v for v, _ in sample})
    up, n = ([sum(f(t) for v, t in sample if v == x) for x in levels] for f in (lambda t: t, lambda t: 1))
    up, n = np.cumsum([0, *up]), np.cumsum([0, *n])
    size = len(levels)
    fitted = [max(min((up[b] - up[a]) / (n[b] - n[a]) for b in range(i + 1, size + 1)) for a in range(i + 1))
              for i in range(size)]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, lab, index).collect()}
    held = [i for i in sorted(of) if i not in number]
    for i in held[:60]:
        v = vote(i)
        want = index.without if v is None else fitted[max(0, int(np.searchsorted(levels, v + 1e-9)) - 1)]
        assert scores[i] == pytest.approx(want, abs=1e-6), i


def test_held_out_labels(spark, docs):
    big = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    q = quality_classifier.quality(d, lab).join(lab, "doc_id").filter("held_out")
    assert q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.97
    t = toxicity.toxicity(d, lab).join(lab, "doc_id").filter("held_out")
    row = t.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))),
                F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert row[0] > 0.65 and row[1] < 0.01


# --- pii and rules ----------------------------------------------------------------

def test_pseudonyms_keep_format_link_and_restore(spark):
    text = ("card 4111 1111 1111 1111, again 4111 1111 1111 1111, born 1984-02-29 not 1984-02-31, "
            "ip 10.1.2.3 not 10.1.2.300, iban DE89370400440532013000, +1 (017) 555-7713, 9807915762804491")
    df = spark.createDataFrame([(1, text), (2, "4111 1111 1111 1111"), (3, None)], "doc_id long, text string")
    out = pii.pseudonymise(df)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[1])
    assert len(set(cards)) == 1 and cards[0] == got[2] != "4111 1111 1111 1111"
    assert pii.luhn(cards[0].replace(" ", ""))
    assert "1984-02-31" in got[1] and "10.1.2.300" in got[1] and "1984-02-29" not in got[1] and got[3] is None
    assert {r["doc_id"]: r["text"] for r in pii.restore(out).collect()} == {1: text, 2: "4111 1111 1111 1111", 3: None}


def test_restore_leaves_other_columns(spark):
    df = spark.createDataFrame([(1, "mail a.b@example.com", "n")], "doc_id long, text string, pii_note string")
    assert pii.restore(pii.pseudonymise(df)).collect() == df.collect()


def test_values_beside_other_digits_are_found_and_restored():
    perm, find = pii.Permutation(pii.KEY), re.compile(pii._FIND)

    def new(text):
        out, kinds = pii.replace_text(text, perm, find)
        assert pii.replace_text(out, perm, find, back=True)[0] == text
        return out, kinds
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    card_new, iban_new = new(card)[0], new(iban)[0]
    for before, after in (("", " 12/27"), ("", " 123"), ("Nr 12 ", ""), ("", " 12 34"), ("Nr 7 ", " 123")):
        assert new(before + card + after) == (before + card_new + after, ["card"])
    out, kinds = new(card + " 31.01.2024")
    assert kinds == ["card", "date"] and out == card_new + " " + new("31.01.2024")[0]
    for before, after in (("", " USD"), ("", " 1234 HELLO"), ("AB12 3456 ", "")):
        assert new(before + iban + after) == (before + iban_new + after, ["iban"])
    for text, kind in (("25/12/2024", "date"), ("+33 1 23 45 67 89", "phone")):
        out, kinds = new(text)
        assert kinds == [kind] and out != text
    assert new("32/13/2024 and 4111 1111 1111 1112")[1] == []
    rng = np.random.default_rng(5)
    for _ in range(20):  # every start of a table of digits may begin a card
        new(" ".join(map(str, rng.integers(0, 10, 120))))


def test_quality_counts_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in quality_rules.quality_report(docs).collect()}
    for d in docs.collect():
        t, r = d["text"] or "", got[d["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(wins)
        covered = {j for i, x in enumerate(wins) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality_rules.COUNTS) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_rules_keep_clean_and_reject_junk(spark, docs):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_rules.quality_report(docs).filter("not base_failed").join(lab, "doc_id")
    assert r.filter("quality = 1 and not kept").count() == 0
    assert r.filter("quality = 0 and kept").count() <= 0.1 * r.filter("quality = 0").count()


def _plain_estimate(x, starts=20):
    """Fast minimum covariance determinant in numpy: of many random starts the
    one of least determinant.  Squared distances, scaled as a chi-square median."""
    floors = np.array([f for _, f in quality_rules.FEATURES.values()])
    rng, h, best = np.random.default_rng(5), math.ceil(quality_rules.SUPPORT * len(x)), None
    for _ in range(starts):
        some = x[rng.choice(len(x), len(floors) + 1, replace=False)]
        for _ in range(30):
            m, c = some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(floors ** 2)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            some = x[np.argsort(d, kind="stable")[:h]]
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, d
    k = len(floors)
    return best[0], best[1], best[2] / max(1.0, np.median(best[2]) / (k * (1 - 2 / (9 * k)) ** 3))


def _verdict_holds(spark, docs, kept):
    """Documents that are clearly inside or outside of the numpy estimate's limit
    (all groups of sf0.01 are small and judged by all documents)."""
    v = quality_rules._vector(quality_rules.counts(docs)).select("doc_id", *quality_rules._X).toPandas()
    ok = v.dropna()
    assert len(ok) and not kept & set(v["doc_id"]) - set(ok["doc_id"])
    _, _, d = _plain_estimate(ok[list(quality_rules._X)].to_numpy(float))
    inside, outside = d < 0.8 * quality_rules.LIMIT, d > 1.25 * quality_rules.LIMIT
    assert (inside | outside).mean() > 0.97 and outside.any()
    assert set(ok["doc_id"][inside]) <= kept and not set(ok["doc_id"][outside]) & kept


def test_estimate_per_group_against_many_starts(spark):
    """Two groups above ``MIN_GROUP`` of unlike scatter with a fifth of outliers, and
    one below it, which gets none of its own."""
    rng, parts = np.random.default_rng(8), []
    for source, n, spread in (("a", 600, 1.0), ("b", 900, 2.5), ("c", 50, 1.0)):
        x = rng.normal(size=(n, 5)) * np.array([0.1, 0.3, 0.1, 0.6, 0.05]) * spread
        x[:, 1] += x[:, 0]
        x[:n // 5] += np.array([2.0, 3.0, 1.0, 4.0, 1.0])
        parts += [("en", source, *map(float, r)) for r in np.round(x * quality_rules.GRID) / quality_rules.GRID]
    df = spark.createDataFrame(parts, "lang string, source string, " + ", ".join(f"{c} double" for c in quality_rules._X))
    got = {r["grp"] and r["grp"]["source"]: r for r in quality_rules.estimate(df).collect()}
    assert set(got) == {"a", "b", None}
    for source in "ab":
        x = np.array([r[2:] for r in parts if r[1] == source])
        logdet, centre, distance = _plain_estimate(x)
        e = got[source]["e"]
        w = np.array([[e[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert abs(-2 * np.log(np.diag(w)).sum() - logdet) < 0.1
        assert np.abs([e[f"m{i}"] for i in range(5)] - centre).max() < 0.05
        mine = (((x - [e[f"m{i}"] for i in range(5)]) @ w.T) ** 2).sum(axis=1) / got[source]["scale"]
        assert np.allclose(mine, distance, rtol=0.15, atol=0.5)


def test_verdict_against_many_starts(spark, docs):
    kept = quality_rules.quality_report(docs).filter("kept").toPandas()["doc_id"]
    _verdict_holds(spark, docs, set(kept))


def test_mix_meets_targets_and_repeats(spark, docs):
    a = mixing.mix_report(docs).toPandas().merge(docs.select("doc_id", "source").toPandas())
    by = a.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most / 2 + 1).all() and (a.taken <= 3 * a["size"]).all()
    copies = mixing.mix(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    times = (a[a["size"] > 0].set_index("doc_id").eval("taken / size")).astype(int)
    assert (copies.reindex(times.index, fill_value=0) == times).all()


def test_mix_cuts_sources_without_letters(spark):
    """All weights alike and small: the cut is still at the budget, and no
    bucket is much larger than the others."""
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("1 2 3").alias("text"),
                                 F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix_report(docs).toPandas().merge(docs.select("doc_id", "source").toPandas())
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 3).all()
    key = mixing.exponential_key(F.col("doc_id"), F.lit(0.05))
    most = docs.groupBy(mixing._bucket(key, 8).alias("b")).count().agg(F.max("count")).first()[0]
    assert most <= n / 64


CLASH = ["mix_size", "mix_key", "mix_salt", "mix_plan", "mix_times", "mix_copy", "mix_row", "bucket", "coarse", "near_key",
         "near_row", "near_doc", "near_text", "near_id"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[2:4])
def test_stages_leave_columns_of_their_own_names_alone(spark, docs, name, stage):
    some = docs.filter("doc_id < 60")
    named = some.select("*", *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH))
    out = stage(spark, named, SF)
    assert out.columns == named.columns
    got = out.toPandas()
    assert all((got[c] == c + got["doc_id"].astype(str)).all() for c in CLASH)
    plain = stage(spark, some, SF).toPandas()["doc_id"]
    assert len(got) > 0 and sorted(got["doc_id"]) == sorted(plain)


def test_pipeline_against_plain_stages(spark):
    """Every stage's rows against plain Python (the mix: its SQL) on that stage's own input."""
    frames, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        frames.append(docs)
        docs = reliable_checkpoint(stage(spark, docs, SF), "test-" + name.replace(" ", "-"))
    rows = [[(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()] for d in frames]
    assert all(len(a) > len(b) > 0 for a, b in zip(rows[:2], rows[1:3]))

    _verdict_holds(spark, frames[0], {i for i, _ in rows[1]})
    best = {}
    for i, t in rows[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        best[key] = max(best.get(key, (-1, 0)), (len(t or ""), -i))
    assert sorted(i for i, _ in rows[2]) == sorted(-i for _, i in best.values())
    assert sorted(i for i, _ in rows[3]) == sorted(set(_near_label(rows[2]).values()))
    con = duckdb.connect()
    con.register("documents", frames[3].toPandas())
    taken = {i: n // size for i, size, n in con.execute(
        f"SELECT doc_id, size, taken FROM ({queries.oracle_sql()['op3_mix_sources']})").fetchall()}
    copies = collections.Counter(i for i, _ in rows[4])
    assert copies == collections.Counter({i: n for i, n in taken.items() if n})
    text, want = dict(rows[4]), collections.Counter()
    for (i, n), e in zip(copies.items(), plain_library().encode_batch([text[i] for i in copies], add_special_tokens=False)):
        ids = np.array(e.ids + [packing.END_ID], np.uint32)
        first = len(ids) % packing.CAPACITY or packing.CAPACITY
        for a, b in zip([0, *range(first, len(ids), packing.CAPACITY)], [*range(first, len(ids) + 1, packing.CAPACITY)]):
            want[i, a, b - a, tokens.ids_crc32(ids[a:b])] += n
    pieces = docs.toPandas()
    assert collections.Counter(pieces[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, p in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(p["offset"]) == [0, *p["length"].cumsum()[:-1]] and p["length"].sum() <= packing.CAPACITY


def test_pipeline_stages_take_effect(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < rows["doc_id"].nunique() < n
    assert rows.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
