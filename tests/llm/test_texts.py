"""The text operators against brute force on small fixtures with nulls, empty and long texts, copies and repeated rows."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickframe.llm import op1_substring, op2_tokens, op3_jaccard, op4_lempel_ziv, op6_lines, op7_pieces, units, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    line = "This line of more than forty characters is in many documents."
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        if i % 4 == 0:
            parts.append("  " + (line if i % 8 else line.upper()) + "\t")
        out.append("\n".join(parts))
    for i in range(0, 40, 2):  # exact and near copies
        out.append(out[i])
        w = out[i].split(" ")
        w[len(w) // 2] = "edited"
        out.append(" ".join(w))
    out += ["", "   \n\t ", "one", "a b c", "a b c", "ABC Def ghi jkl mno", "abc DEF ghi jkl mno", "é ü\x0b漢字  x " * 30, " ".join(["same"] * 500), " ".join(rng.choice(vocab) for _ in range(30_000))]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    rows.append((len(rows), None))
    rows.append((len(rows), rows[3][1]))
    rows = [(i * 3 - 50, t) for i, t in rows]
    random.Random(5).shuffle(rows)
    return rows, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(5)


# the order of bytes.split() and of the word rule must agree
def test_words():
    texts = [(t or "").encode() for _, t in corpus()] + [b"\x00a\x1fb \x85", b"x" * 3_000_000, b""]
    h, at = words.all_word_hashes(texts)
    known = {}
    for k, t in enumerate(texts):
        w = t.split()
        assert at[k + 1] - at[k] == len(w)
        for a, b in zip(w, h[at[k] : at[k + 1]].tolist()):
            assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def windows_removed(rows, width=13):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_substrings(docs):
    rows, df = docs
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in op1_substring.substring_dedup(df).collect())
    want = windows_removed(rows)
    assert got == want and sum(r[2] for r in want) > 1000


def test_difference_cover():
    assert {(a - b) % op1_substring.PERIOD for a in op1_substring.COVER for b in op1_substring.COVER} == set(range(op1_substring.PERIOD))


def test_substrings_of_odd_rows(spark):
    long = " ".join(f"x{k}" for k in range(20))
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in op1_substring.substring_dedup(df.withColumn("batch", F.lit(1))).collect()), key=str)
    assert got == [(1, 20, 0), (1, 20, 0), (2, 20, 20), (None, 0, 0), (None, 20, 0)]
    assert op1_substring.substring_dedup(df.where("false")).count() == 0


def lines_cut(rows):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(low)
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                seen.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(seen.get(key(x), ())) >= 5 and i != max(seen[key(x)]))]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines(docs):
    rows, df = docs
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in op6_lines.line_dedup(df).collect())
    want = lines_cut(rows)
    assert got == want and sum(r[2] for r in want) > 20


def test_lines_of_odd_rows(spark):
    x = "y" * 40
    rows = [(1, x), (1, x), (2, x), (3, x), (4, x), (None, x), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in op6_lines.line_dedup(df).collect()} == {0}  # four documents
    df = spark.createDataFrame([*rows, (5, x)], "doc_id long, text string").withColumn("drop", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted(((r.doc_id, r.n_dropped) for r in op6_lines.line_dedup(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (None, 0), (None, 0)]
    assert op6_lines.line_dedup(df.where("false")).count() == 0
    assert "drop" in op6_lines.line_dedup(df.withColumnRenamed("key", "more"), extra=("more",)).withColumnRenamed("more", "drop").columns


def components(rows, width, num, den):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set()
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                same = len(x & y)
                if den * same >= num * (len(x) + len(y) - same):
                    a_, b_ = find(a), find(b)
                    parent[max(a_, b_)] = min(a_, b_)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("rule", [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard(docs, rule):
    rows, df = docs
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard.jaccard_components(df, *rule).collect())
    want = components(rows, *rule)
    assert got == want and sum(r[0] != r[2] for r in want) > 20


def test_jaccard_of_a_torn_group(spark, monkeypatch):
    """Many copies edited apart: most pairs fall short of the threshold, some don't, and all must be found."""
    rng = random.Random(9)
    base = [f"t{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for p in rng.sample(range(120), rng.randint(1, 6)):
            w[p] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    want = components(rows, 4, 85, 100)
    assert len({r[2] for r in want}) > 5 and any(r[0] != r[2] for r in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (16, 10_000):  # by tiles, and by pairs
        monkeypatch.setattr(op3_jaccard, "PAIRED", most)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard.jaccard_components(df, 4, 85, 100).collect())
        assert got == want


def test_tiles_span_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"v{rng.randrange(12)}" for _ in range(9))) for i in range(90)] + [(100 + i, "a b c d e f g h i " + "j " * (i % 3)) for i in range(12)]
    rule = op3_jaccard.Rule(1, 3, 4)
    monkeypatch.setattr(op3_jaccard, "TILE", 16)
    members = spark.createDataFrame([(k, 0, i, 9) for i, _ in rows for k in (0, 1)], "kind int, group long, doc long, n long")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from tickframe.llm.components import components as spark_components

    got = {r.node: r.component for r in spark_components(op3_jaccard._compare(members, df, rule)).collect()}
    assert [(i, got.get(i, i)) for i, _ in sorted(rows)] == [(i, c) for i, _, c in components(rows, 1, 3, 4)]


def test_chains_of_passages_are_compared_by_signature(spark, monkeypatch):
    """Documents share a passage with the next ones only: compared all together or each signature by itself, links agree."""
    monkeypatch.setattr(op3_jaccard, "PAIRED", 2)
    monkeypatch.setattr(op3_jaccard, "TILE", 8)
    rng = random.Random(11)
    part = [" ".join(f"p{k}x{rng.randrange(10_000)}" for _ in range(25)) for k in range(40)]
    rows = [(i, f"{part[i // 4]} {part[i // 4 + 1]} " + " ".join(f"own{i}y{k}" for k in range(i % 4 * 5))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard.jaccard_components(df, 4, 85, 100).collect())
    want = components(rows, 4, 85, 100)
    assert got == want and 30 <= len({r[2] for r in want}) < 120


def test_unrelated_sets_share_no_signature():
    import numpy as np

    rng = np.random.default_rng(3)
    for num, den in ((80, 100), (85, 100)):
        rule = op3_jaccard.Rule(5, num, den)
        found = np.concatenate([np.unique(rule.signatures(np.sort(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64)))) for n in rng.integers(6, 111, 20_000)])
        assert np.unique(found, return_counts=True)[1].max() <= 10  # 0.05 % of the sets


def test_jaccard_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (1, "A B C D E"), (1, "A B C D E"), (2, None), (4, " ")], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit(1))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op3_jaccard.jaccard_components(df, 4, 85, 100).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 2, 1), (4, 0, 4), (None, 2, None)]
    assert op3_jaccard.jaccard_components(df.where("false")).count() == 0


def test_part_enum_never_misses():
    """Similar sets of any size share a signature."""
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        rule = op3_jaccard.Rule(4, num, den)
        for size in [*range(1, 40), 90, 300, 2000]:
            for _ in range(8):
                s = np.unique(rng.integers(0, (1 << 64) - 1, size, dtype=np.uint64))
                # the smallest intersection still linked when elements are replaced
                change = int(len(s) * (den - num) / (den + num))
                t = np.unique(np.concatenate([s[rng.permutation(len(s))[change:]], rng.integers(0, (1 << 64) - 1, change, dtype=np.uint64)]))
                if rule.linked(s, t):
                    assert np.intersect1d(rule.signatures(s), rule.signatures(t)).size


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, df = docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in op2_tokens.token_counts(df, path).collect())
    want = []
    for i, x in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert op2_tokens.token_counts(df.where("false"), path).count() == 0


ODD = ["a", "b", "the", " ", "  ", "\n", "\t", " ", "　", "é", "1", "23", ".", "!", "'s", "<|endoftext|>", "漢", "\x1c", "\x85", "\r\n", "▁", "<s>", "<0x41>", "🎉", "ing", "tion", "\x00", "   "]


def odd_texts(n=4000, seed=1):
    rng = random.Random(seed)
    return ["", " ", "\n", "  a", "a  ", "▁", *("".join(rng.choice(ODD) for _ in range(rng.randint(1, 16))) for _ in range(n))]


def test_units_put_texts_together_again():
    texts = odd_texts()
    distinct, number, offsets = units.split(pa.array([*texts, None]))
    parts = distinct.to_pylist()
    assert ["".join(parts[k] for k in number[a:b]) for a, b in zip(offsets, offsets[1:])] == [*texts, ""]
    assert len(set(parts)) == len(parts)


def test_odd_token_counts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts()
    distinct, number, offsets = units.split(pa.array(texts))
    got = units.sums(op2_tokens._counts(path, distinct.to_pylist())[number], offsets)
    assert got.tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library():
    import sentencepiece

    path = op7_pieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), op7_pieces.Pieces.load(path)
    texts = odd_texts(seed=2)
    ids = own.encode(pa.array(texts))
    assert ids.to_pylist() == library.encode(texts)
    assert own.decode(ids).to_pylist() == library.decode(library.encode(texts))
    for _ in range(3):  # prefixes' last tokens, not by chance: words long enough for long merges
        w = "".join(random.Random(_).choice("aeinorst") for _ in range(40))
        assert own._tokens("▁" + w) == library.encode(w)


def test_pieces_are_paired_without_merging_each_pair(monkeypatch):
    path = op7_pieces.default_model()
    own, rng, merged = op7_pieces.Pieces(path), random.Random(4), []
    merge = op7_pieces.Pieces.merge
    monkeypatch.setattr(op7_pieces.Pieces, "merge", lambda self, s, *least: merged.append(s) or merge(self, s, *least))
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 12))) for _ in range(200)) for _ in range(20)]
    ids = own.encode(pa.array(texts)).to_pylist()
    # a piece is merged once, to learn its halves; before, 18,671 merges were made here, nearly all of pairs
    assert len(merged) == len(set(merged)) and set(merged) <= own.id.keys()
    tested = [(own.name[a], own.name[b], ok) for b, before in own.fitting.items() for a, ok in before.items() if a >= 0]
    assert len(tested) > 5000 and {ok for *_, ok in tested} == {True, False}
    assert all((merge(own, x + y) == [x, y]) == ok for x, y, ok in tested)
    monkeypatch.setattr(op7_pieces, "PAIRS", 50)  # what is forgotten is tested again
    again = op7_pieces.Pieces(path)
    assert again.encode(pa.array(texts)).to_pylist() == ids
    assert sum(map(len, again.fitting.values())) <= 50


def test_pieces_part_at_unknown_letters():
    import sentencepiece

    path = op7_pieces.default_model()
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), op7_pieces.Pieces.load(path)
    assert not {"\x00", "🦩", "𐍈"} & own.id.keys()
    rng = random.Random(6)
    texts = ["\x00", "𐍈𐍈", "the🦩the", "  \x00  a", "\x00" * 3 + "there"]
    texts += ["".join(rng.choice(["there", "ing", "s", " ", "  ", "\x00", "🦩", "𐍈"]) for _ in range(12)) for _ in range(500)]
    assert own.encode(pa.array(texts)).to_pylist() == library.encode(texts)


def test_pieces_query(docs):
    import sentencepiece

    rows, df = docs
    path = op7_pieces.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_pieces.sentencepiece_digest(df, path).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
    encoded = op7_pieces.sentencepiece_encode(df, path)
    back = {r.doc_id: r.text for r in op7_pieces.sentencepiece_decode(encoded, path).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert op7_pieces.sentencepiece_digest(df.where("false"), path).count() == 0


def fingerprints_by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]

        def phrases(x):
            seen, p = set(), ""
            for c in x:
                p += c
                if p not in seen:
                    seen.add(p)
                    p = ""
            return seen

        a, b, c = (op4_lempel_ziv.least(list(phrases(x))) for x in (t, e, nxt))
        out.append((i, len(t), sha(e), op4_lempel_ziv.name(a), op4_lempel_ziv.name(b), op4_lempel_ziv.likeness(a, b), op4_lempel_ziv.likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprints(docs, monkeypatch):
    rows, df = docs
    short = [r for r in rows if len(r[1] or "") < 20_000]
    monkeypatch.setattr(op4_lempel_ziv.common, "pieces", lambda *a: 7)  # several ranges
    got = sorted((tuple(r) for r in op4_lempel_ziv.edited_likeness(df.where("text IS NULL OR length(text) < 20000")).collect()), key=str)
    assert got == fingerprints_by_hand(short)
    one = {r.doc_id: r.fingerprint for r in op4_lempel_ziv.fingerprints(df).collect()}
    assert all(one[r[0]] == r[3] for r in got)
    apart = [r for r in got if r[6] < 0.6]  # whose next document is no copy
    assert sum(r[5] > r[6] for r in apart) > 0.9 * len(apart) > 90


@pytest.mark.parametrize("rows", [[(1, "only")], [(None, "a b"), (2, None), (2, "x"), (2, "x"), (None, "c")], []])
def test_fingerprints_of_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1))
    assert sorted((tuple(r) for r in op4_lempel_ziv.edited_likeness(df).collect()), key=str) == fingerprints_by_hand(rows)


def test_likeness():
    assert op4_lempel_ziv.likeness([], []) == 1.0 and op4_lempel_ziv.likeness([1], []) == 0.0
    assert op4_lempel_ziv.likeness([1, 2], [2, 3]) == pytest.approx(1 / 3)


_WORKER = """
import random, sys
import pyarrow as pa
from pathlib import Path
from tickframe.llm import op7_pieces, workers

def mb(field):
    return int(Path("/proc/self/status").read_text().split(field + ":")[1].split()[0]) / 1024

rnd = random.Random(7)
letters = "etaoinshrdlucmfwygpbvk"
word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))
common = [word() for _ in range(20_000)]
texts = [" ".join(word() if rnd.random() < 0.15 else common[int(20_000 * rnd.random() ** 3)] for _ in range(400)) for _ in range(4_000)]
batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
del texts, common
path = op7_pieces.default_model()
op7_pieces.Pieces.load(path)
workers.release()
Path("/proc/self/clear_refs").write_text("5")
before, rows = mb("VmRSS"), 0
for b in workers.by_task(lambda x: op7_pieces.digested(op7_pieces.decoded(path)(op7_pieces.encoded(path)(x))))(iter([batch])):
    rows += b.num_rows
print(rows, batch.nbytes >> 20, round(mb("VmHWM") - before))
"""


def test_op7_worker_holds_little_beside_the_batch():
    done = subprocess.run([sys.executable, "-c", _WORKER], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    rows, size, grown = map(int, done.stdout.split())
    assert rows == 4000 and size >= 8
    assert grown < 110  # 149 with slices of 3 MB, 72 with those of 1 MB
