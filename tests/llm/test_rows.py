"""Operators on vectors, conversations, pages and sources against brute force, and the pipeline's stages."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickframe.llm import common, op3_jaccard, op5_descent, op7_pieces, op8_quotes, op9_language, op10_mix, queries
from tickframe.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, at = [], 0

    def add(v, label):
        nonlocal at
        rows.append((at, None if v is None else [float(x) for x in np.asarray(v, np.float32)], label))
        at += 1

    for _ in range(300):
        add(rng.standard_normal(16), int(rng.integers(0, 3)))
    for size, label in ((40, 0), (9, 1), (2, 1), (2, 2), (2, 2)):
        base = rng.standard_normal(16)
        for _ in range(size):
            add(base + 0.03 * rng.standard_normal(16), label)
    copy = rows[-1]
    for _ in range(3):
        add(copy[1], copy[2])
    add(copy[1], 0)
    add(None, 1)
    add([0.0] * 16, 1)
    add(rows[0][1], None)
    rows.append((at, [float("nan")] + [1.0] * 15, 1))
    rows.append((at + 1, [float("inf")] + [1.0] * 15, 1))
    rows.append((at + 2, [1.0] * 8, 1))
    rows.append((at + 3, [1.0] * 8, 1))
    rows.append((at + 4, [2.0 ** 100] * 8, 1))
    return rows


def links(rows, threshold=0.98):
    ok = []
    for i, e, label in rows:
        v = None if e is None or label is None or not all(np.isfinite(e)) or not any(e) else np.array(e, np.float64)
        ok.append(v / np.linalg.norm(v) if v is not None else None)
    n, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= threshold:
                n[rows[a][0]] += 1
                n[rows[b][0]] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    return sorted((i, n[i], find(i), find(i) == i) for i, _, _ in rows)


@pytest.mark.parametrize(("k", "tile"), [(10, 1024), (4, 16)])
def test_vectors(spark, k, tile):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(4).withColumn("node", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in op5_descent.near_dedup(df, k=k, tile=tile, run_length=16, longest=k).collect())
    assert got == links(rows)
    got = sorted(tuple(r) for r in op5_descent.near_dedup(df, k=k, tile=tile).collect())
    assert got == links(rows)


def test_tight_clusters_side_by_side(spark, monkeypatch):
    """More than k neighbours within each cluster, all nearer than the links across."""
    rng = np.random.default_rng(2)
    a = np.eye(16)[0]
    b = 0.985 * a + (1 - 0.985**2) ** 0.5 * np.eye(16)[1]
    rows = [(i, [float(x) for x in np.float32(c + 0.002 * rng.standard_normal(16))], label) for i, (c, label) in enumerate([(a, 1)] * 30 + [(b, 1)] * 30 + [(a, 2)] * 30 + [(-a, 2)] * 30)]
    want = links(rows)
    assert [w[1] for w in want[:60]] == [59] * 60 and {w[2] for w in want} == {0, 60, 90}
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted(tuple(r) for r in op5_descent.near_dedup(df).collect()) == want
    monkeypatch.setattr(op5_descent, "BLOCK", 8)  # several blocks
    assert sorted(tuple(r) for r in op5_descent.near_dedup(df).collect()) == want


def test_short_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(op5_descent, "_audit", lambda *a: 0.5)
    df = spark.createDataFrame([(i, [1.0, 0.1 * i], 1) for i in range(4)], VECTORS)
    with pytest.raises(RuntimeError, match="0.5000"):
        op5_descent.near_dedup(df, trees=300, rounds=1, threshold=0.9, run_length=2).count()


def test_descent_lifts_recall(spark):
    """Two trees alone miss many links of one large label; descent finds them."""
    rng = np.random.default_rng(6)
    x = (np.repeat(rng.standard_normal((1000, 32)), 8, axis=0) + 0.1 * rng.standard_normal((8000, 32))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("label", F.col("label").cast("long"))
    nodes = common.materialize(df.mapInArrow(op5_descent._unit, "vec_id long, label long, dim int, vec binary").select(F.col("vec_id").alias("node"), "label", "dim", "vec", F.lit(1).cast("long").alias("weight")).mapInArrow(op5_descent._single, "node long, label long, dim int, vec binary, weight long, small binary")).df
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, 0)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sim >= 0.98)) if a < b}
    share = lambda g: len(want & {(min(r.u, r.v), max(r.u, r.v)) for r in g.df.where("sim >= 0.9799").collect()}) / len(want)
    graph = common.materialize(op5_descent._best(op5_descent._start(nodes, 10, 16, 2, 10, 5), 10).withColumn("open", F.lit(1)))
    before = share(graph)
    after = share(op5_descent._descend(nodes, graph, 10, 12, 0.98))
    assert before < 0.9 < 0.98 <= after, (before, after)


def test_odd_vectors(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v, 1), (5, v, 1), (5, v, 1), (6, [1.0, None], 1), (7, [], 1)], VECTORS)
    got = sorted((tuple(r) for r in op5_descent.near_dedup(df).collect()), key=str)
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, True)]
    assert op5_descent.near_dedup(df.where("false")).count() == 0


def test_audit_sees_missing_links(spark):
    rows = [(i, [1.0, 0.001 * i], 1) for i in range(20)]
    nodes = spark.createDataFrame(rows, VECTORS).withColumn("label", F.col("label").cast("long")).mapInArrow(op5_descent._unit, "vec_id long, label long, dim int, vec binary").select(F.col("vec_id").alias("node"), "label", "dim", "vec", F.lit(1).cast("long").alias("weight"))
    full = nodes.select("node", F.lit(19).cast("long").alias("n"), F.lit(0).alias("component"))
    assert op5_descent._audit(nodes, full, 0.98) == 1.0
    assert op5_descent._audit(nodes, full.where("node < 10"), 0.98) == 0.5


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(60)]
    edges = [*path, (100, 200), (200, 150), (150, 150), (7, 7), *((300, rng.randrange(301, 400)) for _ in range(200))]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100
    assert {got[v] for _, v in edges if v > 300} == {300} and 7 in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


TALK = [
    (1, 0, "user", "Hello there friend.\nHow are you?\n\nSecond paragraph here."),
    (1, 1, "assistant", "On Monday user wrote:\n> Hello there friend.\n> How are you?\nI am fine."),
    (1, 2, "user", "> I am fine.\n>> hello   THERE friend.\n>> How are you?\nGood."),
    (1, 3, "assistant", "No quote at all > here"),
    (1, 4, "user", "> Second paragraph here.\nwhich one?"),
    (2, 0, "user", "> Good.\nFrom another conversation"),
    (2, 1, "assistant", "ok"),
    (3, 0, "user", " >From another conversation\nchain\r\n"),
    (4, 0, "user", "> nothing known\nx"),
    (4, 1, "user", "> nothing known\nx"),
    (4, 1, "user", "> nothing known\nx"),
    (5, 3000, "user", ""),
    (5, 1, "user", "> ok\n> > Hello there friend.\n> > How are you?\nlate"),
    (None, None, None, None),
]


def talk_by_hand(rows):
    """Conversations as the operator defines them, message by message."""
    low = -(1 << 63)
    msgs = sorted(((low if c is None else c, low if t is None else t, r, x, c, t) for c, t, r, x in rows), key=lambda m: (m[0], m[1], m[2] or "", m[3] or ""))
    split = lambda m: [((lambda q: (q[0].count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)))(re.match(r"((?:[ \t]*>)*)", line))) for line in (m[3] or "").replace("\r", "").split("\n")]

    def passages(lines):
        out, before = [], None
        for d, b in lines:
            if not b.strip():
                before = None
                continue
            if d == before:
                out[-1][1].append(b)
            else:
                out.append((d, [b]))
            before = d
        return [(d, " ".join(" ".join(b).lower().split())) for d, b in out]

    parsed = [split(m) for m in msgs]
    found = [passages(x) for x in parsed]
    out, thread, up = [], {}, {}
    for k, m in enumerate(msgs):
        quotes = [(d, p) for d, p in found[k] if d > 0]
        votes, linked = {}, 0
        for d, p in quotes:
            same = [j for j in range(k) if msgs[j][0] == m[0] and msgs[j][1] < m[1] and (0, p) in found[j]]
            other = [j for j in range(len(msgs)) if (0, p) in found[j]]
            to = same[-1] if same else (other[0] if other and msgs[other[0]][:2] < m[:2] else None)
            if to is not None:
                linked += 1
                votes[d, to] = votes.get((d, to), 0) + 1
        parent, link = None, "root"
        if votes:
            parent, link = max(votes, key=lambda v: (-v[0], votes[v], v[1]))[1], "quote"
            if msgs[parent][0] != m[0]:
                up.setdefault(m[0], msgs[parent][0])
        elif k and msgs[k - 1][0] == m[0]:
            parent, link = k - 1, "turn"
        text = m[3] or ""
        if any(d for d, _ in parsed[k]):
            keep = [b for j, (d, b) in enumerate(parsed[k]) if d == 0 and not (j + 1 < len(parsed[k]) and parsed[k][j + 1][0] > 0 and re.search(r"(?i)^\s*(on\b.*)?\bwrote:\s*$", b))]
            text = "\n".join(keep).strip()
        out.append([m, text, parent, link, max([0, *(d for d, _ in quotes)]), len(quotes), linked])
    for c in {m[0] for m in msgs}:
        thread[c] = c
        while thread[c] in up:
            thread[c] = up[thread[c]]
    seen, result = {}, []
    for m, text, parent, link, depth, n, linked in out:
        t = thread[m[0]]
        pos = seen[t] = seen.get(t, -1) + 1
        p = msgs[parent] if parent is not None else (None,) * 6
        result.append((m[4], m[5], m[2], text, None if t == low else t, pos, p[4], p[5], link, depth, n, linked))
    return result


def test_quotations(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").repartition(3).withColumn("block", F.lit(9)).withColumn("depth", F.lit(9))
    got = [tuple(r) for r in op8_quotes.link_quotations(df).collect()]
    key = lambda r: (str(r[4]), r[5])
    assert sorted(got, key=key) == sorted(talk_by_hand(TALK), key=key) == sorted(by_duckdb(TALK), key=key)
    assert op8_quotes.link_quotations(df.where("false")).count() == 0


def test_quotations_of_hot_groups(spark):
    first, short = "Common opening words of a thread.", "yes"
    rows = [(1, 0, "user", first), (1, 1, "user", "second part\n\nthird part")]
    # one thread of all conversations, one conversation of equal and of missing turns, repeated rows and one hot passage
    rows += [(c, 0, "user", f"> {first}\nanswer {c % 3}") for c in range(2, 60)]
    rows += [(60, None, "user", short)] * 40 + [(60, 7, "user", "> yes\nagain")] * 30
    rows += [(61, t, "user", f"> {first}\n\n" + ("loop" if t % 5 else "> loop\nloop")) for t in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    key = lambda r: (str(r[4]), r[5])
    old = op8_quotes._ranges
    try:
        op8_quotes._ranges = lambda df: 7  # ranges that cut through every hot group
        got = [tuple(r) for r in op8_quotes.link_quotations(df).collect()]
    finally:
        op8_quotes._ranges = old
    assert sorted(got, key=key) == sorted(talk_by_hand(rows), key=key) == sorted(by_duckdb(rows), key=key)


def test_quoted_conversations_link(spark):
    got = op8_quotes.quoted_conversations(spark, "/root/testdata/sf0.001")
    n, quoted, linked = got.agg(F.count("*"), F.sum("n_quoted"), F.sum("n_linked")).first()
    assert n == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count() and quoted > n / 2 and linked == quoted


def by_duckdb(rows):
    import duckdb
    import pyarrow as pa

    c = duckdb.connect()
    names = ("conv_id", "turn", "role", "text")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    c.register("conversations", pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types))}))
    r = c.sql(op8_quotes.ORACLE_SQL)
    order = [r.columns.index(n) for n in ("conv_id", "turn", "role", "text", "thread_id", "position", "parent_conv", "parent_turn", "link", "depth", "n_quoted", "n_linked")]
    return [tuple(row[k] for k in order) for row in r.fetchall()]


def test_many_quotations(spark):
    rng = random.Random(3)
    said, rows = [], []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if said and rng.random() < 0.7:
                    depth = rng.randint(1, 3)
                    lines += ["> " * depth + x for x in rng.choice(said[-15:])]
                own = [f"word {rng.randrange(60)} and {rng.randrange(4)}" for _ in range(rng.randint(1, 2))]
                said.append(own)
                lines += rng.choice([[""], []]) + own
            rows.append((c, t * 700, "user", "\n".join(lines)))
    got = [tuple(r) for r in op8_quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got) == sorted(talk_by_hand(rows)) == sorted(by_duckdb(rows))
    assert len({r[4] for r in got}) < 12 and any(r[8] == "quote" for r in got)


def test_every_message_follows_its_parent(spark, sf):
    got = queries.QUERIES["op8_quotation_linking"](spark, sf).collect()
    at = {(r.conv_id, r.turn): (r.thread_id, r.position) for r in got}
    assert len(at) == len(got) == common.table(spark, sf, "conversations").count()
    for r in got:
        if r.link != "root":
            parent = at[r.parent_conv, r.parent_turn]
            assert parent[0] == r.thread_id and parent[1] < r.position


def test_language_is_held_out(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = op9_language.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    found = op9_language.identify(rest, model).select("lang", "language", "rejected").collect()
    right = sum(r.lang == r.language and not r.rejected for r in found)
    assert right >= 0.99 * len(found)


def test_language_rejects_and_keeps(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = op9_language.fit(docs)
    good = docs.where("n_chars > 200").first().text
    rng = random.Random(1)
    junk = ["", None, "  \n", "12345 678 !!! ???", "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(2000)), "漢字仮名交じり文" * 50]
    rows = [(i, t) for i, t in enumerate([good, good * 300, good, *junk])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("clash")).withColumn("__n", F.lit(5)).withColumn("___post", F.lit("kept")).withColumn("rejected", F.lit(9))
    out = op9_language.identify(df, model)
    assert out.columns == ["doc_id", "text", "__n", "___post", "language", "confidence", "rejected", "n_trigrams"]
    found = out.collect()
    assert {r.doc_id: r.rejected for r in found} == {k: k > 2 for k in range(len(rows))}
    assert all(r["__n"] == 5 and r["___post"] == "kept" for r in found)
    assert op9_language.identify(df.where("false"), model).count() == 0


def test_steps_change_nothing(monkeypatch):
    text = "Grüße aus München, 漢字 and more. " * 3000
    model = op9_language.TextModel(["a", "b"], np.random.default_rng(1).integers(0, 9, (2, op9_language.SLOTS)).astype(float))
    for step in (1, 7, 1024, len(text.encode()), len(text.encode()) + 1):
        short = text if step > 100 else text[:200]
        monkeypatch.setattr(op9_language, "STEP", 1 << 30)
        whole, judged = op9_language._counts(short), model.judge(short)
        monkeypatch.setattr(op9_language, "STEP", step)
        assert np.array_equal(op9_language._counts(short), whole)
        assert model.judge(short)[0] == judged[0] and np.allclose(model.judge(short)[1], judged[1], rtol=0, atol=1e-9)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(op9_language, "LANGUAGES", 2)
    rows = spark.createDataFrame([("some text", x) for x in "abc"], "text string, lang string")
    with pytest.raises(ValueError, match="2 at most"):
        op9_language.fit(rows)
    assert op9_language.fit(rows, languages=["a", "c"]).languages == ["a", "c"]


def fused_by_hand(rows, model, smooth=20.0):
    """Posterior of each row (id, text, declared, suffix, host, domain) from all evidence, by plain loops."""
    n_lang, judged = len(model.languages), []
    for r in rows:
        n, mean = model.judge(r[1])
        logs = mean * min(n, op9_language.EFFECTIVE)
        post = np.exp(logs - logs.max())
        judged.append((n, logs, post / post.sum()))
    used = [(r, j) for r, j in zip(rows, judged) if j[0] > 0]
    base = 1.0 + sum((j[2] for _, j in used), np.zeros(n_lang))
    prior = base / base.sum()
    count = lambda at, v: sum((j[2] for r, j in used if r[at] == v), np.zeros(n_lang))
    out = {}
    for r, (n, logs, _) in zip(rows, judged):
        total = logs.copy()
        for at in (2, 3):
            c = count(at, r[at])
            if r[at] is not None and c.sum() > 0:
                total += np.log((c + (c.sum() + 0.5) / (base.sum() + 1.0)) / (base + 1.0))
        towards = prior
        if r[5] is not None and count(5, r[5]).sum() > 0:
            towards = (count(5, r[5]) + smooth * prior) / (count(5, r[5]).sum() + smooth)
        c = count(4, r[4]) if r[4] is not None else np.zeros(n_lang)
        total += np.log((c + smooth * towards) / (c.sum() + smooth))
        post = np.exp(total - total.max())
        post /= post.sum()
        out[r[0]] = (model.languages[int(post.argmax())] if n else None, float(post.max()))
    return out


def test_fused_evidence_equals_brute_force(spark):
    rng = random.Random(8)
    texts = {"en": ["the cat and the dog", "of all the things", "in"], "de": ["der hund und die katze", "von allen dingen", "in"], "fr": ["le chat et le chien", "de toutes les choses", "en"]}
    train = spark.createDataFrame([(" ".join(rng.choice(v) for _ in range(9)), k) for k, v in texts.items() for _ in range(20)], "text string, lang string")
    model = op9_language.fit(train)
    rows = []
    for i in range(160):
        lang = rng.choice("en de fr".split())
        host = rng.choice([None, f"{rng.randrange(3)}.{lang}.org", "mixed.com"])
        rows.append((i, rng.choice([*texts[lang], " ".join(texts[lang]), "", None, "12 34"]), rng.choice([None, lang, "en"]), rng.choice([None, lang, "org"]), host, host and host[-7:]))
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string").repartition(3)
    found = op9_language.identify(df, model, declared="declared", suffix="suffix", host="host", domain="domain").collect()
    want = fused_by_hand(rows, model)
    assert {r.id: r.language for r in found} == {k: v[0] for k, v in want.items()}
    assert all(abs(r.confidence - want[r.id][1]) < 1e-9 for r in found)


def test_registered_language_query_equals_brute_force(spark, sf):
    import html

    pages = common.table(spark, sf, "pages").collect()
    model = op9_language.fit(common.table(spark, sf, "documents"))
    rows = []
    for r in pages:
        text = html.unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", r.html)).replace("\xa0", " ") if r.html is not None else None
        found = re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", r.html or "")
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)(?:[^/?#]*/([A-Za-z]{2})(?:[/?#-]|$))?", r.url or "")
        host = m[1].lower() if m else None
        part = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", r.url or "")
        last = re.search(r"\.([a-z]+)$", host or "")
        suffix = part[1].lower() if part else last[1] if last else None
        domain = re.search(r"([^.]+\.[^.]+)$", host or "")
        rows.append((r.page_id, text, found[1].lower() if found else None, suffix, host, domain[1] if domain else None))
    want = fused_by_hand(rows, model)
    got = queries.QUERIES["op9_language_id"](spark, sf).collect()
    assert len(got) == len(rows) > 0
    by = {r[0]: r for r in rows}
    for g in got:
        assert (g.declared, g.suffix, g.host) == by[g.page_id][2:5]
        assert g.language == want[g.page_id][0] and abs(g.confidence - want[g.page_id][1]) < 1e-9


def test_evidence_decides_short_texts(spark):
    """A text that says little goes by its host; a host without documents of its own by its domain."""
    train = spark.createDataFrame([("the and of " * 20, "en"), ("der und die " * 20, "de")], "text string, lang string")
    model = op9_language.fit(train)
    rows = [(i, "der und die das", "a.x.de", "x.de") for i in range(30)] + [(100, "in", "a.x.de", "x.de"), (101, "in", "b.x.de", "x.de"), (102, "in", None, None)] + [(200 + i, "the and of", "y.org", "y.org") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, host string, domain string")
    plain = {r.id: r.language for r in op9_language.identify(df, model, sure=0.0).collect()}
    got = {r.id: (r.language, r.confidence) for r in op9_language.identify(df, model, host="host", domain="domain", sure=0.0).collect()}
    assert got[100][0] == got[101][0] == "de" and got[100][1] > 0.6 and plain[5] == "de" and plain[200] == "en"
    assert got[102][0] == plain[102] and got[200][0] == "en"


@pytest.mark.parametrize("sample", [0, 5])
def test_repeated_texts_leave_the_sample_whole(spark, sample):
    once = spark.createDataFrame([(f"{w} und {w} oder", "de") for w in ("haus", "maus", "baum")] + [(f"{w} and {w} or", "en") for w in ("house", "mouse", "tree")], "text string, lang string")
    often = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("lang") == "de", 3000).otherwise(1)))).drop("k")
    model = op9_language.fit(often, sample=sample)
    assert np.array_equal(model.log, op9_language.fit(once, sample=sample).log)
    assert not np.array_equal(model.log[:, 0], model.log[:, 1])
    assert model.judge("haus und haus oder")[1].argmax() == 0 and model.judge("house and house or")[1].argmax() == 1


@pytest.mark.parametrize(
    ("url", "host", "domain", "suffix"),
    [("https://Blog.A.example.de:80/x", "blog.a.example.de", "example.de", "de"), ("http://x.example.com/fr/12?a", "x.example.com", "example.com", "fr"), ("http://u@y.org", "y.org", "y.org", "org"), ("nonsense", None, None, None), (None, None, None, None)],
)
def test_addresses(spark, url, host, domain, suffix):
    df = spark.createDataFrame([(url,)], "url string").select(op9_language.host_of(F.col("url")).alias("h"), op9_language.suffix_of(F.col("url")).alias("s")).withColumn("d", op9_language.domain_of(F.col("h")))
    assert tuple(df.select("h", "d", "s").first()) == (host, domain, suffix)


def test_markup(spark):
    html = "<!DOCTYPE html><HTML class=a lang='DE-at'><script>var x='<p>no</p>';</script><!-- no --><p>ja&amp;nein</p></HTML>"
    r = spark.createDataFrame([(html,)], "h string").select(op9_language.declared_of(F.col("h")), op9_language.text_of(F.col("h"))).first()
    assert r[0] == "de" and op9_language.references(r[1]).split() == ["ja&nein"]
    assert op9_language.references("gr&uuml;&szlig;e&nbsp;&#228;") == "grüße ä" and op9_language.references("a & b") == "a & b"


def test_late_markup(spark):
    html = f"<!-- {'licence ' * 2000} -->" + "\n" * 5000 + '<html lang="fr">'
    assert spark.createDataFrame([(html,)], "h string").select(op9_language.declared_of(F.col("h"))).first()[0] == "fr"


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its limit. sizes: (source, words) in order."""
    w = {s: weights[k % 3] for k, (s, _) in enumerate(sizes)}
    limit, total = {s: most * n for s, n in sizes}, share * sum(n for _, n in sizes)
    fixed = {}
    while True:
        free = [s for s, _ in sizes if s not in fixed]
        rest = total - sum(fixed.values())
        out = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > limit[s]]
        if not over:
            return fixed | out
        fixed |= {s: limit[s] for s in over}


def mix_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for source, n in (("b", 700), ("a", 30), ("é", 5), (None, 60), ("Z", 1), ("empty", 3)):
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * (0 if source == "empty" else rng.choice([0, 1, 3, 10, 40]))), source))
    rows += [(rows[0][0], rows[0][1], "b")] * 40 + [(None, None, "b"), (None, "x y", None), (5000, "w " * 3000, "a")]
    return rows


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(op10_mix, "BLOCK", 16)  # several levels
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("p", F.lit(1)).withColumn("copies", F.lit(1)).withColumn("target", F.lit(1))
    got = op10_mix.mix(df).collect()
    words = lambda t: len((t or "").split())
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(i), words(t), str(s)) for i, t, s in rows)
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + words(t)
    order = sorted(total.items(), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    want = shares(order)
    for s, n in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and r.source_size == n for r in own)
        taken = sum(r.copies * r.size for r in own)
        assert abs(taken - want[s]) <= max(r.size for r in own)
        ratio = want[s] / n if n else 0
        assert all(r.copies in ((int(ratio + 1e-9), int(ratio + 1e-9) + 1) if r.size else (0,)) and r.copies <= 2 for r in own)
    again = op10_mix.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_keeps_expectations(spark):
    """Over many seeds each document is taken about as often as its share asks for."""
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate("aab" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = common.materialize(op10_mix.grouped(df)).df
    goal = common.materialize(op10_mix.targets(groups)).df
    n, taken = 12, {}
    for seed in range(n):
        for r in op10_mix.rounded(groups, goal, seed).collect():
            taken[r.source] = taken.get(r.source, 0) + r.total / n
    ratio = {r.source: r.target / r.source_size for r in goal.collect()}
    count = {s: sum(x == s for _, _, x in rows) for s in "ab"}
    assert all(abs(taken[s] / count[s] - ratio[s]) < 0.1 for s in "ab")


def test_one_doc_id_in_several_sources(spark, monkeypatch):
    """Equal ids and sizes in other sources, null ids too, keep rows of their own; large groups are dealt in chunks."""
    monkeypatch.setattr(op10_mix, "CHUNK", 16)
    rows = [(i, "a b c", s) for i in (1, 2, None) for s in ("x", "y", None)] + [(7, "q w", "x")] * 100 + [(None, "q w", "y")] * 40 + [(7, "q w", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = op10_mix.mix(df).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((key((r.doc_id, r.size, r.source)) for r in got)) == sorted(key((i, len(t.split()), s)) for i, t, s in rows)
    groups = {}
    for r in got:
        groups.setdefault((r.doc_id, r.source, r.size), []).append(r.copies)
    for (_, source, size), copies in groups.items():
        assert max(copies) - min(copies) <= 1 and max(copies) <= 2
    for source in ("x", "y", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 3


def fold_by_hand(items, draw):
    """Pivotal rounding of [id, weight, fraction] in order, one by one; draw gives each pair's number in [0, 1)."""
    out, left = {}, None
    for x in items:
        if left is None:
            left = list(x)
        else:
            a, b = left, list(x)
            up, down = min((1 - a[2]) * a[1], b[2] * b[1]), min(a[2] * a[1], (1 - b[2]) * b[1])
            move = up if draw(a[0], b[0]) * (up + down) < down else -down
            a[2], b[2] = a[2] + move / a[1], b[2] - move / b[1]
            done, left = (a, b) if min(a[2], 1 - a[2]) <= min(b[2], 1 - b[2]) else (b, a)
            out[done[0]] = round(done[2])
        if min(left[2], 1 - left[2]) < 1e-9:
            out[left[0]], left = round(left[2]), None
    return out, left


def test_fold_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, float(rng.choice([1, 2, 5, 9])), rng.choice([0.1, 0.25, 0.5, 0.75])) for i in range(40)]
    hashed = spark.createDataFrame([(a, wa, b, wb) for a, wa, _ in items for b, wb, _ in items if a != b], "a long, wa double, b long, wb double")
    zero = F.lit(0).cast("long")
    draws = {(r.a, r.b): r.u for r in hashed.select("a", "b", op10_mix._uniform(F.lit(3), F.lit("pivot"), "a", zero, "wa", "b", zero, "wb").alias("u")).collect()}
    df = spark.createDataFrame([([(w, p, i, 0, 1, 0) for i, w, p in items],)], f"xs array<{op10_mix._ITEM}>")
    got = df.select(op10_mix._fold(F.col("xs"), 3).alias("f")).first().f
    want, left = fold_by_hand(items, lambda a, b: draws[a, b])
    assert {d.doc_id: d.p for d in got.done} == want
    assert (left is None and got.left is None) or (got.left.doc_id == left[0] and abs(got.left.p - left[2]) < 1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "s")]])
def test_small_mixes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op10_mix.mix(df).collect()
    assert len(got) == len(rows) and all(r.copies <= 2 for r in got)


NATIVE = ("op8_quotation_linking", "op10_mix")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_run_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_equal_duckdb(spark, sf, name):
    from duck import same

    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLE_SQL:
        same(df, queries.ORACLE_SQL[name], sf)
    else:
        assert df.count() > 0


def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, common.materialize(stage(spark, kept, sf)).df
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS
        assert kept.join(before.select("doc_id").distinct(), "doc_id", "left_anti").isEmpty()
        if name == "language":
            assert kept.count() == docs.count()  # all of these are clean
        if name == "lines":
            assert kept.count() == before.count()
            assert kept.where("n_chars <> length(text)").isEmpty()
        if name == "near_copies":
            one = op3_jaccard.jaccard_components(before, 5, 80, 100)
            assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in one.where("doc_id = component_id").collect())
        if name == "mix":
            sized = before.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
            words = sized.agg(F.sum("n")).first()[0]
            taken = kept.select("doc_id").join(sized, "doc_id").agg(F.sum("n")).first()[0]
            assert abs(taken - 1.5 * words) < 0.1 * words
    out = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())


def lines_by_hand(rows, min_chars=40, min_docs=5):
    space, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(space).translate(lower)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    return [(doc, "\n".join(x for x in (text or "").split("\n") if gone.get(key(x), doc) == doc)) for doc, text in rows]


def groups_by_hand(rows, width=5, num=80, den=100):
    sets, up = {}, {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {x: root(x) for x in ids}


def test_pipeline_stages_equal_brute_force(spark, sf):
    import hashlib

    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, sf, "documents")
    given = docs.orderBy("doc_id").collect()
    legal = "All rights reserved by the people who wrote this page, wherever they are."
    texts = {r.doc_id: r.text for r in given}
    for k, r in enumerate(given[:9]):
        texts[r.doc_id] += f"\n  {legal.upper() if k % 2 else legal}\t"
    long_ = [r for r in given if len(r.text.split()) > 200]
    rows = [(r.doc_id, texts[r.doc_id], r.lang, r.source, r.n_chars) for r in given]
    for k, r in enumerate(long_[:12]):  # copies, some with a few words changed
        words = texts[r.doc_id].split(" ")
        for at in range(0, len(words), 90 if k % 2 else 10**9):
            words[at] = "changed"
        rows.append((5000 + k, " ".join(words), r.lang, r.source if k % 3 else "other", 0))
    odd = [(9000, None, "en", "s", 0), (9001, "", None, None, 0), (9002, " \n ", "en", None, 0)]
    df = spark.createDataFrame(rows + odd, docs.select(*corpus_pipeline.COLUMNS).schema).repartition(3)
    run = lambda name, df: common.materialize(stages[name](spark, df, sf)).df

    kept = run("language", df)
    assert sorted(map(tuple, kept.collect())) == sorted(rows)  # texts in no language go, all others stay as they are
    cut = run("lines", kept)
    want = sorted(lines_by_hand([(r.doc_id, r.text) for r in kept.collect()]))
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == want
    assert sum(legal.lower() in (x or "").lower() for _, x in want) == 1
    assert {(r.doc_id, r.n_chars) for r in cut.collect()} == {(d, len(x)) for d, x in want}
    one = run("near_copies", cut)
    group = groups_by_hand(want)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, c in group.items() if d == c)
    assert sum(d != c for d, c in group.items()) >= 12

    mixed = run("mix", one)
    copies, words = {}, {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    before = {r.doc_id: r for r in one.collect()}
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in before.values()}
    for r in before.values():
        words.setdefault(r.source, {})[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    targets = shares([(s, sum(words[s].values())) for s in sorted(words)])
    for s, sizes in words.items():
        ratio = targets[s] / sum(sizes.values())
        taken = sum(copies.get(d, 0) * n for d, n in sizes.items())
        assert abs(taken - targets[s]) <= max(sizes.values()) + 1e-6
        assert all(np.floor(ratio - 1e-9) <= copies.get(d, 0) <= np.ceil(ratio + 1e-9) for d in sizes)

    library = sentencepiece.SentencePieceProcessor(model_file=op7_pieces.default_model())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(r.doc_id, library.encode(r.text)) for r in mixed.collect()]
    pieces = [tuple(r) for r in run("pieces", mixed).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(pieces) == sorted((d, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for d, x in ids)


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words of a text that says nothing much at all " * 3
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, " ".join(f"long {k}" for k in range(40_000)), "en", "s", 1)]
    spark.createDataFrame(rows, schema).withColumn("copies", F.lit(1)).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()]
    assert set(got) <= {1, 4, None} and 4 in got
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline_keeps_the_last_table_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    same = lambda spark, docs, sf: docs.withColumn("n", F.col("n") + 1)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", same), ("b", same), ("c", same)])
    spark.range(3).select(F.col("id").alias("n")).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [3, 4, 5]
    assert [f.name for f in tmp_path.glob("corpus-pipeline/*/*")] == ["2-c"]
