"""Token counts, filter audit and source divergence: against the library, brute
force over awkward rows, and DuckDB (``test_query_matches_oracle``)."""

import collections
import itertools
import random
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

from seatflow.llm import filter_audit, source_divergence, token_counts

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, part string, n long"
LONG = " ".join(f"Word{'abcdefghij'[i % 10]}{'xyz' * (i % 7)}" for i in range(60_000))


def odd_rows():
    texts = ["a b  c\n d", "a b c d", None, "", " \n\t ", LONG, LONG + " tail", "x y \U0001f642 é <s> ▁▁ end", "A|B",
             "one two three " * 40, "CAPITALS EVERYWHERE " * 30, " ".join(f"w{i}" for i in range(60)), "Ünïcode ÀÉ É é"]
    rows = [(i, t, ("en", "de", None, "")[i % 4], ("s", "t", None, "", "u")[i % 5], 1, "h", "p", 5)
            for i, t in enumerate(texts * 4)]
    rows += [(None, "a b c d", "en", "s", 1, None, None, None), (None, None, "en", "s", 1, None, None, None)]
    rows += [(1, "a b c d", "en", "s", 1, None, None, None)] * 3  # repeated rows
    rows += [(1000 + i, "copy of one passage", "en", "s", 1, None, None, None) for i in range(300)]  # a hot text
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- token counts ---------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.model_file())


@pytest.mark.parametrize("window", [7, token_counts.WINDOW])
def test_token_counts_equal_the_library(monkeypatch, library, window):
    monkeypatch.setattr(token_counts, "WINDOW", window)
    count = token_counts.Counter(token_counts.model_file()).tokens
    rng = random.Random(3)
    letters = " ▁  \n\t\r0123abcdeéﬁ　.,</s>_'\"ABthein\U0001f600漢字한́\x00​ẞ\xa0"
    texts = ["", "<s></s><unk><0x0A>", " lead", "trail ", "▁a▁▁b", "   \n   x", "don't 3.14", "�"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(10_000)]
    assert [count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_token_counts_of_documents(spark, library, odd, empty):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = collections.Counter()
        for r in docs.collect():
            t = r["text"] or ""
            n = len(library.encode(t))
            want[r["doc_id"], len(t.encode()), n, n > 4096] += 1
        got = token_counts.count_tokens(docs)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert collections.Counter(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(empty).collect() == []


def test_one_endless_word(library):
    count = token_counts.Counter(token_counts.model_file())
    word = "Aller" + "anfang" * 30_000
    assert count.tokens(word) == len(library.encode(word)) and len(count) == 0  # not remembered


def test_models_of_another_kind_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(token_counts.model_file(), "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        token_counts.Vocabulary(str(other))


# --- filter audit ---------------------------------------------------------------

def audit(rows, labels):
    """part, order, step -> counts, one document and order at a time."""
    texts = collections.defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None:
            texts[r["text"] or ""].append(r["doc_id"])
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    out = collections.defaultdict(lambda: [0] * 7)
    shapley = collections.Counter()
    for r in rows:
        t, i, part = r["text"] or "", r["doc_id"], r["source"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(x < i for x in texts[t])}
        for order in map("".join, itertools.permutations("ABCDE")):
            removed = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                now = fails[f] and not removed
                row[1] += now
                row[2] += fails[f] and removed
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += now and i in good
                row[5] += now and i in toxic
                removed |= fails[f]
                row[0] += not removed
                shapley[part, f] += now
    for (part, order, step), row in out.items():
        row[6] = shapley[part, order[step - 1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("salt_rows", [7, filter_audit.SALT_ROWS])
def test_filter_audit_against_brute_force(spark, monkeypatch, odd, empty, salt_rows):
    monkeypatch.setattr(filter_audit.repeated_ids, "__defaults__", (salt_rows,))
    labels = [(i, i % 3 % 2, i % 2) for i in range(60)] + [(1, 1, None), (1, None, 1), (None, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(odd, lab).collect()
    want = audit(odd.collect(), [x for x in labels if x[0] is not None])
    assert len(got) == len(want) and {tuple(r[:3]): tuple(r[3:]) for r in got} == want
    assert filter_audit.filter_audit(empty, lab).collect() == []


def test_a_shared_hash_is_no_equal_text(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_hash", lambda text: F.unhex(F.md5(F.lit("same"))))
    rows = [(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, "c", "t"), (5, "b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = filter_audit.repeated_ids(docs, filter_audit.marks(docs))
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 5]


# --- source divergence ------------------------------------------------------------

def divergence(rows, min_docs, top):
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    n, df = collections.Counter(), collections.Counter()
    groups = set()
    for r in rows:
        g = (r["lang"] or "", r["source"] or "")
        groups.add(g)
        found = collections.Counter(word.findall((r["text"] or "").translate(lower)))
        for t, k in found.items():
            n[(*g, t)] += k
            df[g[0], t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), k in df.items() if x == lang and k >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            size = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 1) // (size + len(kept)) for t in kept}

        p = {s: shares(lambda t: n[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(n[lang, s, t] for s in sources))
        for s in sources:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, s, t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("min_docs,top,keys", [(3, 200, 200_000), (1, 3, 5), (99, 200, 200_000)])
def test_source_divergence_against_brute_force(spark, monkeypatch, odd, empty, min_docs, top, keys):
    monkeypatch.setattr(source_divergence, "KEYS", keys)
    got = source_divergence.source_divergence(odd, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence(odd.collect(), min_docs, top)
    assert source_divergence.source_divergence(empty).collect() == []


def test_products_beyond_a_long_stay_exact(spark):
    counts = [0, 10**13, 9 * 10**17]
    rows = spark.createDataFrame([(c, 10**18, 12345) for c in counts], "c long, size long, vocabulary long")
    got = [r[0] for r in rows.select(source_divergence._p("c", "size")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (10**18 + 12345) for c in counts]
