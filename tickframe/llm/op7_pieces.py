"""SentencePiece (BPE) encoding by a table of each prefix's last token, and decoding by pieces.

In byte-pair encoding every prefix of a text has one encoding, and its last token t is the only vocabulary match ending
there for which the encoding of what precedes t ends in a token compatible with t (the two, encoded together, stay the
two). An automaton over the pieces lists the matches, a memory of tested pairs at each piece answers compatibility, the
table is filled from left to right in one pass and the ids are read off backwards. No match ends at a letter of no piece,
so it parts what precedes it from what follows, and is spelled in bytes. Pieces never hold a space mark after another
character, so texts are cut before spaces (see units) and each distinct part is encoded once a batch.

A pair is tested by taking back the merges that made its two tokens, the latest first: they stay apart unless, at some
time, the tokens on both sides of their border make a piece that comes before the merge taken back last.

The marks' runs in this kind of model have equal scores, where "leftmost first" decides and prefixes lose the property
above: parts with two marks in a row are merged directly with a priority queue.

Nulls: a null text counts as empty and has no ids; null ids decode to an empty text. Rows are independent: repeated rows
give repeated results. Other columns of the input are kept by neither function.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units, workers

MARK = "▁"
#: Bytes of text encoded at once, and of the memory of encoded parts: what a worker holds comes on top of its executor's heap.
SLICE_BYTES = 1 << 20
KNOWN_BYTES = 12 << 20
#: Pairs remembered, of about 50 bytes each; when there are more, all are forgotten.
PAIRS = 200_000
#: In place of a token where there is none: before the first, and at a letter of no piece.
NONE = -1
_loaded: dict[str, Pieces] = {}


class Pieces:
    """A BPE vocabulary with byte fallback, ready to encode."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(size)])
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model must have a piece for each byte")
        normal = [i for i in range(size) if not (self.special[i] or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.text[i]: i for i in normal}
        self.score = {self.text[i]: model.get_score(i) for i in normal}
        if any(MARK in t.lstrip(MARK) for t in self.id):
            raise ValueError("pieces must not hold a space mark after another character")
        letters = {c for t in self.id for c in t}
        # a letter of some piece that is no piece itself is a token of its own, spelled in bytes
        self.loose = {c: size + k for k, c in enumerate(sorted(letters - self.id.keys()))}
        self.other = re.compile("[^" + "".join(map(re.escape, sorted(letters))) + "]")
        self.match = ahocorasick.Automaton()
        self.fitting = {i: {} for i in (self.id | self.loose).values()}  # of each token, the ones before it tested so far
        self.tested = 0
        for t, i in (self.id | self.loose).items():
            self.match.add_word(t, (i, len(t), self.fitting[i]))
        self.match.make_automaton()
        self.length = {i: len(t) for t, i in (self.id | self.loose).items()}
        self.name = {i: t for t, i in (self.id | self.loose).items()}
        order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {t: order[x] for t, x in self.score.items() if len(t) > 1}  # when a merge makes it
        self.halves: dict[str, list[str]] = {}
        self.known = units.Memory(KNOWN_BYTES)
        raw = [bytes([int(t[3:5], 16)]) if i in set(self.byte_ids.values()) else b"" if s else t.replace(MARK, " ").encode() for i, (t, s) in enumerate(zip(self.text, self.special))]
        self.raw = pa.array(raw, pa.large_binary())

    @classmethod
    def load(cls, path: str) -> Pieces:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merge(self, s: str, least: int = 1) -> list[str]:
        """Plain byte-pair merging: best score first, leftmost among equals, until `least` tokens are left."""
        part, right, left = list(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        alive, queue = len(s), []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(s) and (score := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-score, i, part[i], part[j]))

        for i in range(len(s)):
            offer(i)
        while queue and alive > least:
            _, i, a, b = heapq.heappop(queue)
            j = right[i]
            if part[i] != a or j >= len(s) or part[j] != b:
                continue
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[j] < len(s):
                left[right[j]] = i
            alive -= 1
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in part if p]

    def split(self, t: str) -> list[str]:
        """The two tokens whose merge makes a piece."""
        found = self.halves.get(t)
        if found is None:
            found = self.halves[t] = self.merge(t, 2)
            if len(found) != 2:
                raise ValueError(f"merges must make each piece, but not {t!r}")
        return found

    def apart(self, x: str, y: str) -> bool:
        """Whether two tokens, encoded together, stay the two."""
        rank, before = self.rank, math.inf
        while True:
            if rank.get(x + y, math.inf) < before:
                return False
            u, v = rank.get(x, -1), rank.get(y, -1)
            if u > v:
                x, before = self.split(x)[1], u
            elif v >= 0:  # among equals the leftmost is merged first: the right one's merge is the later one
                y, before = self.split(y)[0], v + 1
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow a."""
        if self.tested >= PAIRS:
            for x in self.fitting.values():
                x.clear()
            self.tested = 0
        found = self.fitting[b][a] = a == NONE or self.apart(self.name[a], self.name[b])
        self.tested += 1
        return found

    def _spell(self, c: str) -> list[int]:
        return [self.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")]

    def _tokens(self, s: str) -> list[int]:
        """Tokens of a text by the prefix table, with NONE for each letter of no piece."""
        last, done = [NONE] * (len(s) + 1), -1  # of each prefix by its last letter's place; the empty one is the place -1
        for end, (t, n, fitting) in self.match.iter(s):
            if end != done:
                p = last[end - n]
                ok = fitting.get(p)
                if self.fits(p, t) if ok is None else ok:
                    last[end], done = t, end
        out, at, length = [], len(s) - 1, self.length
        while at >= 0:
            t = last[at]
            out.append(t)
            at -= 1 if t < 0 else length[t]
        out.reverse()
        return out

    def _merged(self, s: str) -> list[int]:
        """The same by merging the parts between letters of no piece that have two space marks in a row."""

        def part(x: str) -> list[int]:
            return [self.id.get(p, self.loose.get(p)) for p in self.merge(x)] if MARK + MARK in x else self._tokens(x)

        out, at = [], 0
        for m in self.other.finditer(s):
            out += part(s[at : m.start()])
            out.append(NONE)
            at = m.end()
        return out + part(s[at:])

    def unit(self, s: str) -> list[int]:
        """Ids of a part of a text, spaces written as marks."""
        out = self._merged(s) if MARK + MARK in s else self._tokens(s)
        if NONE in out or self.loose and max(out, default=0) >= len(self.text):
            at, spelled = 0, []
            for i in out:
                if i < 0 and s[at] in self.id:
                    raise ValueError("no token found that ends at a letter of the model")
                spelled += [i] if 0 <= i < len(self.text) else self._spell(s[at])
                at += 1 if i < 0 else self.length[i]
            return spelled
        return out

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # mark every text's start as the model's dummy prefix does; literal marks are spaces to the model
        full = pc.replace_substring(texts, MARK, " ")
        full = pc.if_else(pc.equal(full, ""), full, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), full, pa.scalar(" ", pa.large_string())))
        distinct, number, offsets = units.split(full)
        parts = distinct.to_pylist()
        del texts, full, distinct
        ids = [self.known.get(u) for u in parts]
        for k, found in enumerate(ids):
            if found is None:
                ids[k] = found = array("i", self.unit(parts[k].replace(" ", MARK))).tobytes()
                self.known.keep(parts[k], found)
        flat = np.frombuffer(b"".join(ids), np.int32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        del parts, ids
        start = np.cumsum(size) - size
        n = size[number]
        to = np.cumsum(n)
        total = int(to[-1]) if len(to) else 0
        take = np.repeat(start[number] - (to - n), n)
        take += np.arange(total)
        ends = np.concatenate([[0], to])[offsets]
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat[take] if total else np.zeros(0, np.int32), pa.int32()))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: the pieces' bytes joined, marks as spaces, without the dummy prefix."""
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        ids = ids.cast(pa.large_list(pa.int32()))
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
        raw = self.raw.take(ids.flatten())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1][offsets] if len(raw) else np.zeros(len(offsets), np.int64)
        data = raw.buffers()[2].to_pybytes() if len(raw) else b""
        return pa.array([data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())


def encoded(model: str):
    """Record batches (doc_id, text) to (doc_id, ids)."""

    def run(batches):
        pieces = Pieces.load(model)
        for b in units.balanced(batches, most=SLICE_BYTES):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pieces.encode(b.column("text")).cast(pa.list_(pa.int32()))})
            workers.release()  # what the slice took; the next one's peak would come on top of it
        pieces.known.clear()

    return run


def decoded(model: str):
    """Record batches (doc_id, ids) to (doc_id, ids, text)."""

    def run(batches):
        pieces = Pieces.load(model)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "text": pieces.decode(part.column("ids"))})

    return run


def digested(batches):
    """Record batches (doc_id, ids, text) to the number of ids and the SHA-256 of ids (decimal, joined by commas) and text."""
    for b in batches:
        lists = b.column("ids").cast(pa.list_(pa.int32()))
        names = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), lists.flatten().cast(pa.string()))
        joined = pc.binary_join(names, ",").cast(pa.binary())
        sha = [hashlib.sha256(x).hexdigest() for x in joined.to_pylist()]
        text = [hashlib.sha256(x).hexdigest() for x in b.column("text").cast(pa.binary()).to_pylist()]
        size = pc.list_value_length(lists).cast(pa.int64())
        yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": size, "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(text, pa.string())})


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def sentencepiece_encode(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (no begin or end ids), one row for each input row. model: path of a .model file."""
    return _docs(documents).mapInArrow(workers.by_task(encoded(model)), "doc_id long, ids array<int>")


def sentencepiece_decode(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, text, one row for each input row."""
    return tokens.select("doc_id", "ids").mapInArrow(decoded(model), "doc_id long, ids array<int>, text string")


def sentencepiece_digest(documents: DataFrame, model: str) -> DataFrame:
    """Encoding, decoding and digests in one pass of one worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    encode, decode = encoded(model), decoded(model)
    return _docs(documents).mapInArrow(workers.by_task(lambda batches: digested(decode(encode(batches)))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(common.table(spark, sf_dir, "documents"), default_model())
