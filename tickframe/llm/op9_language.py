"""Language identification by Bayesian fusion of evidence.

A document's language is judged by the product of: the likelihood of its text under a byte-trigram model of each
language; how often documents of that language declare the language they declare in their markup, and have the address
suffix they have (both estimated from the corpus itself, by grouped aggregation of the text's judgement); and a prior from
its host, smoothed towards its domain's, which is smoothed towards the whole corpus's.

The trigram model is fitted on a bounded sample of labelled rows (see fit()). All counts for evidence and priors cover
every document. They are sums per (host), (domain), (declared), (suffix), combined before the shuffle; a hot host costs a
row a task. The only joins are with these sums; adaptive execution splits a hot host's rows or broadcasts small sums.

Text evidence is tempered: neighbouring trigrams overlap and are not independent, so their mean log-likelihood ratio
counts for at most EFFECTIVE trigrams. A document is rejected if its text holds no known letters' trigrams, is unlike every known
language (mean log-likelihood a trigram under the best language below `floor`), or the fused posterior of the best
language is below `sure`.

Nulls: a null or empty text is rejected; null markup, address, host or domain is no evidence. Rows are judged alone, so
repeated rows get equal results. Other columns are kept under their names, but for those of the result (language,
confidence, rejected, n_trigrams), which replace columns of the same names. Texts of any length are read in steps that
share their edges, so that a step's end changes nothing.
"""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, workers

#: Distinct labelled texts used to fit the text model, about, for each language; the sample is the least by hash.
SAMPLE = 1000
#: Languages a model may have: it is sent to every task whole. More are refused, not cut.
LANGUAGES = 1024
#: Bytes of a text that are hashed in one step; bounds memory, not what is read.
STEP = 1 << 20
SLOTS = 1 << 16
EFFECTIVE = 60
_LETTER = np.ones(256, bool)
_LETTER[:0x41] = False
_LETTER[0x5B:0x61] = False
_LETTER[0x7B:0x80] = False
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[~_LETTER] = 32
_FOLD[0x41:0x5B] += 32


def _slots(text: bytes) -> np.ndarray:
    """Slot of each byte trigram with a letter in its middle; letters lower-cased (A-Z), all else a space."""
    b = _FOLD[np.frombuffer(text, np.uint8)]
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x = x[b[1:-1] != 32] * np.uint32(0x9E3779B1)
    return x >> np.uint32(16)


def _steps(text: str | None) -> Iterator[np.ndarray]:
    """The slots of a whole text, step by step; each step begins with the last two bytes of the one before."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
    for at in range(0, len(raw) - 2, STEP):
        yield _slots(raw[at : at + STEP + 2])


def _counts(text: str | None) -> np.ndarray:
    total = np.zeros(SLOTS, np.int64)
    for s in _steps(text):
        total += np.bincount(s, minlength=SLOTS)
    return total


class TextModel:
    """Log-probabilities of trigram slots by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        # the corpus model smooths each language's
        whole = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * SLOTS)
        share = (counts + 200.0 * whole) / (counts.sum(axis=1, keepdims=True) + 200.0)
        self.log = np.ascontiguousarray(np.log(share).T)

    def judge(self, text: str | None) -> tuple[int, np.ndarray]:
        """(trigrams, mean log-likelihood a trigram by language)."""
        n, total = 0, np.zeros(len(self.languages))
        for s in _steps(text):
            n += len(s)
            for k in range(len(total)):
                total[k] += self.log[:, k].take(s).sum()
        return n, total / max(n, 1)


def fit(labelled: DataFrame, languages: list[str] | None = None, sample: int = SAMPLE) -> TextModel:
    """Fit on labelled rows (text, lang): of each language the distinct texts whose hash lies under a bound that leaves about `sample` of them, one at least."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").select("text", "lang")
    if languages is not None:
        rows = rows.where(F.col("lang").isin(languages))
    hashes = rows.select("lang", F.xxhash64("text").alias("hash")).distinct()
    sizes = {r["lang"]: (r["n"], r["least"]) for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")).limit(LANGUAGES + 1).collect()}
    languages = sorted(sizes) if languages is None else languages
    if len(languages) > LANGUAGES:
        raise ValueError(f"{len(languages)} languages, {LANGUAGES} at most; name those to fit")
    counts = np.zeros((len(languages), SLOTS))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                total[lang] = total.get(lang, 0) + _counts(t)
        if total:
            yield pa.record_batch({"lang": pa.array(list(total)), "counts": pa.array([x.astype(np.int32).tobytes() for x in total.values()], pa.binary())})

    bounds = []
    for lang in languages:
        n, least = sizes.get(lang, (1, -(1 << 63)))
        upto = min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, sample / n)))
        bounds += [F.lit(lang), F.lit(max(upto, least)).cast("long")]
    bound = F.element_at(F.create_map(*bounds), F.col("lang")) if bounds else F.lit(None).cast("long")
    some = rows.where(F.xxhash64("text") <= bound).distinct().coalesce(8)
    for r in some.mapInArrow(workers.by_task(count), "lang string, counts binary").collect():
        counts[languages.index(r["lang"])] += np.frombuffer(bytes(r["counts"]), np.int32)
    return TextModel(languages, counts)


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


def domain_of(host: Column) -> Column:
    """The last two labels of a host: what is left when sites' own names are cut."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))


def suffix_of(url: Column) -> Column:
    """The address's language hint: a leading two-letter path part, else the host's last label."""
    part = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1)), F.lit(""))
    return F.coalesce(part, F.nullif(F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1), F.lit("")))


def declared_of(html: Column) -> Column:
    """The language a page's markup declares."""
    found = F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return F.lower(F.nullif(found, F.lit("")))


def text_of(html: Column) -> Column:
    """A page's text: scripts, styles, comments and tags cut. Character references stay (see references)."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def references(text: str) -> str:
    """A page's text with its character references decoded, spaces that don't break as plain ones."""
    return html.unescape(text).replace("\xa0", " ") if "&" in text else text


#: Columns that identify() adds.
RESULT = ("language", "confidence", "rejected", "n_trigrams")


def identify(documents: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, domain: str | None = None, sure: float = 0.5, floor: float = -13.0, smooth: float = 20.0, decode: Callable[[str], str] | None = None) -> DataFrame:
    """All columns of documents, with language, confidence, rejected and n_trigrams.

    declared, suffix, host, domain: names of columns that hold this evidence. smooth: documents a host (or domain) must
    have before its own counts weigh as much as what it is smoothed towards. decode: what each text goes through first.
    """
    own = [c for c in documents.columns if c not in RESULT]
    # names of this function's own columns: with more underscores in front than any column has
    u = "_" * (1 + max([1, *(len(c) - len(c.lstrip("_")) for c in documents.columns)]))
    languages = model.languages
    names = {"declared": declared, "suffix": suffix, "host": host, "domain": domain}

    def judge(batches):
        for b in batches:
            texts = b.column(f"{u}text").to_pylist()
            found = [model.judge(t if decode is None or t is None else decode(t)) for t in texts]
            n = np.array([f[0] for f in found], np.int64)
            mean = np.array([f[1] for f in found]).reshape(len(found), len(languages))
            logs = mean * np.minimum(n, EFFECTIVE)[:, None]
            best = mean.max(axis=1, initial=-np.inf)
            post = np.exp(logs - logs.max(axis=1, initial=-np.inf, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            columns = {c: b.column(c) for c in b.schema.names if c != f"{u}text"}
            lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
            yield pa.record_batch(columns | {f"{u}n": pa.array(n), f"{u}best": pa.array(best), f"{u}logs": lists(logs), f"{u}post": lists(post)})

    plain = documents.select(*(F.col(f"`{c}`") for c in own), F.col(text).cast("string").alias(f"{u}text"), *(F.col(c).cast("string").alias(f"{u}{k}") if c else F.lit(None).cast("string").alias(f"{u}{k}") for k, c in names.items()))

    def judged(rows: DataFrame) -> DataFrame:
        schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != f"{u}text"]
        return rows.mapInArrow(workers.by_task(judge), ", ".join([*schema, f"{u}n long", f"{u}best double", f"{u}logs array<double>", f"{u}post array<double>"]))

    # texts are judged twice, once for the sums and once for the result: cheaper than to keep them anywhere in between
    keys = [f"{u}{k}" for k, c in names.items() if c]
    sums = [F.sum(F.get(f"{u}post", F.lit(k))).alias(f"s{k}") for k in range(len(languages))]
    kept = common.materialize(judged(plain.select(f"{u}text", *keys)).where(F.col(f"{u}n") > 0).groupBy(*keys).agg(*sums)).df
    counted, sums = kept, [F.sum(f"s{k}").alias(f"s{k}") for k in range(len(languages))]
    whole = counted.agg(*sums).first()
    base = [(whole[k] or 0.0) + 1.0 for k in range(len(languages))]
    prior = [x / sum(base) for x in base]

    def table(key: str) -> DataFrame:
        return counted.where(F.col(f"{u}{key}").isNotNull()).groupBy(f"{u}{key}").agg(*sums)

    def array(*columns) -> Column:
        return F.array(*columns).cast("array<double>")

    s = [F.col(f"s{k}") for k in range(len(languages))]
    scored = judged(plain)
    # how likely each language's documents are to show this value: (count + 1 x its share in the corpus) / (language + 1)
    for key in ("declared", "suffix"):
        if names[key]:
            total = sum(s[1:], s[0])
            share = (total + 0.5) / (sum(base) + 1.0)
            seen = table(key).select(f"{u}{key}", array(*(F.log((s[k] + share) / (F.lit(base[k]) + 1.0)) for k in range(len(languages)))).alias(f"{u}{key}_log"))
            scored = scored.join(seen, f"{u}{key}", "left")
    # domain smoothed towards the corpus, host towards its domain
    if names["domain"]:
        n = sum(s[1:], s[0])
        rows = table("domain").select(f"{u}domain", array(*((s[k] + smooth * prior[k]) / (n + smooth) for k in range(len(languages)))).alias(f"{u}domain_prior"))
        scored = scored.join(rows, f"{u}domain", "left")
    else:
        scored = scored.withColumn(f"{u}domain_prior", F.lit(None).cast("array<double>"))
    towards = F.coalesce(f"{u}domain_prior", array(*(F.lit(p) for p in prior)))
    if names["host"]:
        rows = table("host").select(f"{u}host", array(*s).alias(f"{u}host_sums"))
        scored = scored.join(rows, f"{u}host", "left")
        n = F.aggregate(F.coalesce(f"{u}host_sums", array(*(F.lit(0.0) for _ in prior))), F.lit(0.0), lambda a, x: a + x)
        prior_log = array(*(F.log((F.coalesce(F.get(f"{u}host_sums", F.lit(k)), F.lit(0.0)) + smooth * F.get(towards, F.lit(k))) / (n + smooth)) for k in range(len(languages))))
    else:
        prior_log = array(*(F.log(F.get(towards, F.lit(k))) for k in range(len(languages))))
    logs = [F.get(f"{u}logs", F.lit(k)) + F.get(prior_log, F.lit(k)) + sum((F.coalesce(F.get(f"{u}{key}_log", F.lit(k)), F.lit(0.0)) for key in ("declared", "suffix") if names[key]), F.lit(0.0)) for k in range(len(languages))]
    fused = scored.withColumn(f"{u}fused", array(*logs)).withColumn(f"{u}top", F.array_max(f"{u}fused"))
    weights = F.transform(f"{u}fused", lambda x: F.exp(x - F.col(f"{u}top")))
    fused = fused.withColumn(f"{u}at", F.array_position(f"{u}fused", F.col(f"{u}top"))).withColumn(f"{u}sum", F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))
    language = F.element_at(F.array(*(F.lit(x) for x in languages)), F.col(f"{u}at").cast("int"))
    confidence = 1.0 / F.col(f"{u}sum")
    # texts of a few trigrams are no evidence of being unlike a language
    rejected = (F.col(f"{u}n") == 0) | ((F.col(f"{u}n") >= 20) & (F.col(f"{u}best") < floor)) | (confidence < sure)
    return fused.select(*(F.col(f"`{c}`") for c in own), F.when(F.col(f"{u}n") > 0, language).alias("language"), confidence.alias("confidence"), rejected.alias("rejected"), F.col(f"{u}n").alias("n_trigrams"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all pages, with a text model fitted on documents."""
    model = fit(common.table(spark, sf_dir, "documents").select("text", "lang"))
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ready = pages.select("page_id", "url", text_of(F.col("html")).alias("text"), declared_of(F.col("html")).alias("declared"), suffix_of(F.col("url")).alias("suffix"), host_of(F.col("url")).alias("host")).withColumn("domain", domain_of(F.col("host")))
    found = identify(ready, model, declared="declared", suffix="suffix", host="host", domain="domain", decode=references)
    return found.select("page_id", "declared", "suffix", "host", "language", "confidence", "rejected", "n_trigrams")
