"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put in size bands so narrow that two sets of the wanted similarity lie in the same or in
neighbouring bands. For each such pair of bands the largest possible difference k of two similar sets is known. The domain
of shingle hashes is cut into n1 parts of n2 atoms each, such that in at least one part at most k2 elements differ; then
the two sets agree on some n2 - k2 of its atoms. Enumerating these subsets of atoms, hashed with their content, gives
signatures of which two similar sets share one for certain. Empty projections tell nothing and are always left out. If a
set has so few of them that some part sure to agree has none, it loses nothing by that, and neither do its partners. Sets
with more of them send prefix signatures too: with shingles in order of hash, two similar sets share one among the first
few of each. So no signature is shared without common content.

Sets of one slice of documents send their signatures to buckets by hash, 5 bytes each; equal sets of a slice send them
once. A signature that several sets of a slice have is sent once too, and the members go on by themselves, so a bucket
holds at most one entry a slice of any signature. Signatures found twice become rows (signature, set).

Rows are not paired with each other. Each is paired with the least document of its signature only, and these pairs are
verified exactly on whole texts and merged to components. Only signatures some of whose members are then still apart go
on, so no link between different texts is lost: if they have few members, those of different components are paired;
the members of larger ones are compared in tiles of bounded size, each of which returns a forest of the links it finds and
no pairs. Tiles are cut from each signature by itself, or from all members of signatures that hang together, whichever
makes fewer comparisons: the latter where the same documents share many signatures, the former where chains of shared
passages run through the corpus. Both ways compare every two members of a signature.

Nulls: a null or blank text has an empty set and links with nothing; rows with a null doc_id link with nothing and have no
component. Rows that share a doc_id are one document for linking. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, units, words, workers
from .components import components

_LOW40 = np.uint64((1 << 40) - 1)
#: Members up to which a signature's documents are paired; those of larger ones are compared in tiles. The links found agree.
PAIRED = 16
#: Documents and shingles of one side of a tile, about.
TILE = 1024
TILE_SHINGLES = 1 << 20


class Rule:
    """The link rule (similarity >= num / den on shingles of width words) and its signature plan."""

    def __init__(self, width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den
        self.low = [1]  # least size of each band

    def similar_sizes(self, s: int, t: int) -> bool:
        return self.den * min(s, t) >= self.num * max(s, t)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """a, b: sorted distinct shingle hashes."""
        if not len(a) or not len(b) or not self.similar_sizes(len(a), len(b)):
            return False
        both = np.concatenate([a, b])
        both.sort()
        same = int(np.count_nonzero(both[1:] == both[:-1]))
        return self.den * same >= self.num * (len(a) + len(b) - same)

    def band(self, size: int) -> int:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, size, "right")) - 1

    @lru_cache(maxsize=4096)  # noqa: B019  one rule lives as long as its worker's task
    def plan(self, j: int):
        """(parts, atoms a part, subsets as a 0/1 matrix, parts sure to agree, salts) for sets of bands j and j + 1."""
        self.band(self.low[-1] if len(self.low) > j + 2 else 1)
        while len(self.low) <= j + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        top = self.low[j + 1] - 1
        k = (top + min(self.low[j + 2] - 1, top * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)
        k2, n2 = (1, 3) if k else (0, 1)
        n1 = -(-(k + 1) // (k2 + 1))
        n1 += n1 // 10  # some parts more than needed, so that a few empty ones do no harm
        subsets = np.array([[int(a in c) for a in range(n2)] for c in combinations(range(n2), n2 - k2)], np.uint64)
        salts = words.mix(np.arange(1, n1 * len(subsets) + 1, dtype=np.uint64) + (np.uint64(j) << np.uint64(40))).reshape(n1, -1)
        return n1, n2, subsets, n1 - k // (k2 + 1), salts

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a set of sorted distinct shingle hashes."""
        own = self.band(len(s))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(s))])
        out, short = [], False
        for j in (own - 1, own):
            if j < 0:
                continue
            n1, n2, subsets, sure, salts = self.plan(j)
            atom = ((s >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
            cut = np.searchsorted(atom, np.arange(n1 * n2 + 1, dtype=np.uint64))
            sums = (total[cut[1:]] - total[cut[:-1]]).reshape(n1, n2)
            size = np.diff(cut).reshape(n1, n2)
            value = np.zeros_like(salts)
            count = np.zeros(salts.shape, np.int64)
            for c, subset in enumerate(subsets):
                for a in np.flatnonzero(subset):
                    value[:, c] += sums[:, a]
                    count[:, c] += size[:, a]
            empty = count == 0
            short = short or int(np.count_nonzero(empty.any(axis=1))) >= sure
            out.append(words.mix(value ^ salts)[~empty])
        if short:
            least = -(-len(s) * self.num // self.den)  # shingles that a similar set shares at least
            first = words.mix(s[: len(s) - least + 1])
            out += [words.mix(first ^ np.uint64((2 * j + 1) << 40)) for j in (own - 1, own) if j >= 0]
        return np.concatenate(out)

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        h, at = words.all_word_hashes([t.lower() for t in texts])  # bytes.lower() changes A-Z only
        coef = words.coefficients(self.width, 31)
        rolled = words.rolling(h, self.width, coef)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= self.width:
                out.append(np.unique(rolled[a : b - self.width + 1]))
            elif b > a:
                out.append(words.mix(np.array([int((h[a:b] * coef[: b - a]).sum()) ^ (b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


_INFO = np.dtype([("doc", "<i8"), ("has", "u1"), ("n", "<i8"), ("one", "<u8"), ("two", "<u8")])
_LOCAL = np.dtype([("key", "<u8"), ("doc", "<i8"), ("n", "<i4")])
_OWNER = np.dtype([("doc", "<i8"), ("n", "<i4"), ("many", "u1"), ("count", "<i4")])
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("entries", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])


def _bytes(texts: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def _send(rule: Rule, buckets: int):
    """Documents to blobs: what is known of each document, rows of locally shared signatures, entries for the buckets."""

    def run(batches):
        turn = 0
        for b in units.balanced(batches):
            ids = b.column("doc_id").to_pylist()
            sets = rule.shingles(_bytes(b.column("text")))
            info = np.zeros(len(ids), _INFO)
            first: dict[tuple, int] = {}
            for i, (d, s) in enumerate(zip(ids, sets)):
                one, two = int(words.mix(s).sum()), int(words.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum())
                info[i] = (d or 0, d is not None, len(s), one, two)
                if d is not None and len(s):
                    key = (len(s), one, two)
                    if key not in first or d < ids[first[key]]:
                        first[key] = i
            rows = [(int(words.mix(np.array([turn], np.uint64))[0] % np.uint64(buckets)), 0, b"", info.tobytes())]
            some = sorted(first.values(), key=lambda i: ids[i])
            if some:
                sigs = [rule.signatures(sets[i]) for i in some]
                owner = np.repeat(np.arange(len(some)), [len(x) for x in sigs])
                sig = np.concatenate(sigs)
                key = ((sig >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (sig & _LOW40)
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                count = np.diff(np.r_[start, len(key)])
                many = np.repeat(count > 1, count)
                doc = np.array([ids[i] for i in some], np.int64)
                n = np.array([len(sets[i]) for i in some], np.int32)
                if many.any():
                    x = np.empty(int(many.sum()), _LOCAL)
                    x["key"], x["doc"], x["n"] = key[many], doc[owner[many]], n[owner[many]]
                    for at in range(0, len(x), 20_000):
                        turn += 1
                        rows.append((int(words.mix(np.array([turn], np.uint64))[0] % np.uint64(buckets)), 1, b"", x[at : at + 20_000].tobytes()))
                key, owner, flag = key[start], owner[start], (count > 1).astype(np.uint8)
                bucket = key >> np.uint64(40)
                order = np.lexsort((flag, owner, bucket))
                key, owner, flag, bucket = key[order], owner[order], flag[order], bucket[order]
                low = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5]
                run_ = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1]) | (flag[1:] != flag[:-1])])
                own = np.empty(len(run_), _OWNER)
                own["doc"], own["n"], own["many"], own["count"] = doc[owner[run_]], n[owner[run_]], flag[run_], np.diff(np.r_[run_, len(key)])
                at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                own_at = np.searchsorted(run_, at)
                for k, i, j, oi, oj in zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(key)], own_at.tolist(), [*own_at[1:].tolist(), len(own)]):
                    rows.append((k, 2, own[oi:oj].tobytes(), low[i:j].tobytes()))
            turn += 1
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(_SENT.types)], schema=_SENT)

    return run


def _found(kind: int, size: int, **columns) -> pa.Table:
    blank = np.zeros(size, np.int64)
    return pa.table([pa.array(np.full(size, kind, np.int32)), *(pa.array(columns.get(c, blank)) for c in ("key", "doc", "n", "one", "two"))], schema=_FOUND)


def _bucket(key, rows):
    kinds, owners, entries = rows["kind"].to_pylist(), rows["owners"].to_pylist(), rows["entries"].to_pylist()
    out = [_FOUND.empty_table()]
    info = np.frombuffer(b"".join(e for k, e in zip(kinds, entries) if k == 0), _INFO)
    if len(info):
        t = _found(0, len(info), key=info["has"].astype(np.int64), doc=info["doc"].copy(), n=info["n"].copy(), one=info["one"].copy().view(np.int64), two=info["two"].copy().view(np.int64))
        out.append(t)
    local = np.frombuffer(b"".join(e for k, e in zip(kinds, entries) if k == 1), _LOCAL)
    if len(local):
        out.append(_found(1, len(local), key=local["key"].copy().view(np.int64), doc=local["doc"].copy(), n=local["n"].astype(np.int64)))
    own = np.frombuffer(b"".join(o for k, o in zip(kinds, owners) if k == 2), _OWNER)
    if len(own):
        wide = np.zeros((int(own["count"].sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(e for k, e in zip(kinds, entries) if k == 2), np.uint8).reshape(-1, 5)
        sig = wide.view(np.uint64).ravel()
        owner = np.repeat(np.arange(len(own)), own["count"])
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        # members of a signature that was shared in its slice have gone on already, but for slices where it was not
        keep = np.repeat(count > 1, count) & (own["many"][owner] == 0)
        x = own[owner[keep]]
        full = (np.uint64(key[0].as_py()) << np.uint64(40)) | sig[keep]
        out.append(_found(1, len(x), key=full.view(np.int64), doc=x["doc"].copy(), n=x["n"].astype(np.int64)))
    return pa.concat_tables(out)


def _verify(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose texts are linked, as (u, v)."""
    texts = docs.where("doc_id IS NOT NULL")
    one = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    two = one.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")

    def check(batches):
        known: dict[str, np.ndarray] = {}
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                a_text, b_text = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
                new = list({t for t in (*a_text, *b_text) if t is not None and t not in known})
                if len(known) > 1024:
                    known = {t: known[t] for t in {*a_text, *b_text} if t in known}
                known |= zip(new, rule.shingles([t.encode("utf-8", "surrogatepass") for t in new]))
                ok = [x is not None and y is not None and rule.linked(known[x], known[y]) for x, y in zip(a_text, b_text)]
                yield pa.record_batch({"u": b.column("a"), "v": b.column("b")}).filter(pa.array(ok, pa.bool_()))

    return two.select("a", "b", "text_a", "text_b").mapInArrow(workers.by_task(check), "u long, v long").distinct()


def _common(a: list[np.ndarray], b: list[np.ndarray], step: int = 1024) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by products of incidence matrices."""
    values = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column = np.unique(values, return_inverse=True)
    first = row < len(a)
    wide = column.max(initial=-1) + 1
    both = (np.bincount(column[first], minlength=wide) > 0) & (np.bincount(column[~first], minlength=wide) > 0)
    keep = both[column]
    number = np.cumsum(both) - 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(both.sum()), step):
        i, j = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(a) + len(b), step), np.float32)
        x[row[i:j], column[i:j] - at] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int64)


def _tile(rule: Rule):
    def run(key, rows):
        docs, texts = rows["doc"].to_pylist(), rows["text"].to_pylist()
        low, high = key[2].as_py(), key[3].as_py()
        side = (rows["block"].to_numpy() == low).tolist()
        sets = rule.shingles([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        a = [i for i, x in enumerate(side) if x]
        b = a if low == high else [i for i, x in enumerate(side) if not x]
        if not a or not b:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        same = _common([sets[i] for i in a], [sets[i] for i in b])
        size = np.array([len(s) for s in sets])
        linked = (rule.den * same >= rule.num * (size[a][:, None] + size[b][None, :] - same)) & (same > 0)
        label = np.arange(len(docs))  # least number reachable, until it no longer changes
        x, y = np.nonzero(linked)
        x, y = np.array(a)[x], np.array(b)[y]
        while len(x):
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (new == label).all():
                break
            label = new
        hung = np.flatnonzero(label != np.arange(len(docs)))
        return pa.table({"u": pa.array([docs[i] for i in hung], pa.int64()), "v": pa.array([docs[label[i]] for i in hung], pa.int64())})

    return run


def _compare(members: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) that connect what is linked within each group of members (kind, group, doc, n shingles)."""
    group = ["kind", "group"]
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / float(TILE), F.sum("n") / float(TILE_SHINGLES))).cast("long")
    size = members.groupBy(*group).agg(blocks.alias("blocks"))
    dealt = members.join(size, group).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc")
    rows = dealt.join(docs.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "doc"), "doc").select(*group, "low", "high", "block", "doc", "text")
    return rows.groupBy(*group, "low", "high").applyInArrow(workers.by_group(_tile(rule)), "u long, v long").where("u <> v").distinct()


def jaccard_components(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), one row for each input row.

    Two documents link when den * |intersection| >= num * |union| of their sets of width-word shingles.
    """
    rule = Rule(width, num, den)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = common.pieces(docs)
    sent = docs.mapInArrow(workers.by_task(_send(rule, buckets)), "bucket int, kind int, owners binary, entries binary")
    found = common.materialize(sent.groupBy("bucket").applyInArrow(workers.by_group(_bucket), "kind int, key long, doc long, n long, one long, two long")).df
    info = found.where("kind = 0").select(F.when(F.col("key") == 1, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), "one", "two")
    classes = info.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"))
    # every linkable document with the least document of an equal set
    rep = info.where("doc_id IS NOT NULL AND n_shingles > 0").join(classes, ["n_shingles", "one", "two"]).select("doc_id", "rep").distinct()
    rep = common.materialize(common.few(rep, found)).df
    shared = found.where("kind = 1").select("key", "doc", "n")
    pivots = shared.groupBy("key").agg(F.min_by(F.struct("doc", "n"), "doc").alias("p"))

    def reps(pairs: DataFrame) -> DataFrame:
        """Pairs of documents to distinct pairs of their equal sets' least documents."""
        a = rep.withColumnsRenamed({"doc_id": "x", "rep": "a"})
        b = rep.withColumnsRenamed({"doc_id": "y", "rep": "b"})
        return pairs.join(a, "x").join(b, "y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    fit = f"{den} * least(n, m) >= {num} * greatest(n, m)"
    starred = shared.join(pivots, "key").select("key", "doc", "n", F.col("p.doc").alias("pivot"), F.col("p.n").alias("m"))
    pairs = reps(starred.where("doc <> pivot").where(fit).select(F.col("pivot").alias("x"), F.col("doc").alias("y")).distinct())
    pairs = common.materialize(common.few(pairs, found)).df
    links = common.materialize(common.few(_verify(pairs, docs, rule), pairs, narrow=False)).df
    joined = rep.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    part = common.materialize(common.few(components(links.unionByName(joined)), rep)).df

    def part_of(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(part.withColumnsRenamed({"node": column, "component": name}), column, "left").withColumn(name, F.coalesce(name, column))

    # signatures with members that are still apart from their pivot
    apart = part_of(part_of(starred.where("doc <> pivot").select("doc", "pivot").distinct(), "doc", "c"), "pivot", "d").where("c <> d").select("doc", "pivot")
    apart = common.materialize(common.few(apart, found)).df
    if not apart.isEmpty():
        torn = starred.join(apart, ["doc", "pivot"], "left_semi").select("key").distinct()
        members = common.materialize(common.few(part_of(shared.join(torn, "key", "left_semi"), "doc", "c"), found)).df
        size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        members = common.materialize(common.few(members.join(size, "key"), members)).df
        few = members.where(F.col("size") <= PAIRED)
        other = few.select("key", F.col("doc").alias("y"), F.col("n").alias("m"), F.col("c").alias("d"))
        rest = few.withColumnRenamed("doc", "x").join(other, "key").where("x < y AND c <> d").where(fit).select("x", "y").distinct()
        rest = common.materialize(common.few(reps(rest).join(pairs, ["a", "b"], "left_anti"), found)).df
        more = _verify(rest, docs, rule)
        many = members.where(F.col("size") > PAIRED).select("key", "doc", "n")
        if not many.isEmpty():
            # each document stands for its equal set; few distinct pairs are left of many memberships
            own = many.join(rep.withColumnRenamed("doc_id", "doc"), "doc").select("key", F.col("rep").alias("doc"), "n").distinct()
            own = common.materialize(common.few(own, members)).df
            hung = own.join(own.groupBy("key").agg(F.min("doc").alias("v")), "key").select(F.col("doc").alias("u"), "v").distinct()
            hung = common.materialize(common.few(hung, own)).df
            whole = components(hung)
            whole = common.materialize(common.few(whole, hung)).df
            # comparisons of each way: the square of the members of all signatures that hang together, or of each one's
            one = own.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("node")).join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
            each = one.groupBy("component").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("each"))
            together = whole.groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("all"))
            apart_ = each.join(together, "component").where(F.col("each") < F.col("all") * F.col("all")).select("component")
            split = common.materialize(common.few(apart_, hung)).df
            sizes = own.groupBy("doc").agg(F.min("n").alias("n")).withColumnRenamed("doc", "node")
            by_part = whole.join(split, "component", "left_anti").join(sizes, "node").select(F.lit(0).alias("kind"), F.col("component").alias("group"), F.col("node").alias("doc"), "n")
            by_key = own.join(one.join(split, "component", "left_semi").select("key"), "key", "left_semi").select(F.lit(1).alias("kind"), F.col("key").alias("group"), "doc", "n")
            more = more.unionByName(_compare(common.materialize(by_part.unionByName(by_key)).df, docs, rule))
        more = common.materialize(common.few(more, members, narrow=False)).df
        if not more.isEmpty():
            part = common.materialize(common.few(components(links.unionByName(joined).unionByName(more)), rep)).df
    out = info.join(part.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"), width=4, num=85, den=100)


#: DuckDB: every pair of documents that share a shingle, and all that each can reach.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), l AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)
), r AS (
  SELECT doc_id, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""
