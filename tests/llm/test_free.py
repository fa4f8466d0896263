"""Chat formatting, quality network, WARC audit, token counts and the Jaccard join."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import chat_format, jaccard_join, quality_cnn, token_counts, warc_fixity

SMALL = "/root/testdata/sf0.001"


def test_escape_round_trip():
    r = random.Random(1)
    bits = [*chat_format.CONTROL, "\\", "<", "[", "s>", "|im_end|>", "\n", "é"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        out = chat_format.escaped(t)
        assert chat_format.unescaped(out) == t and not any(c in out for c in chat_format.CONTROL)
        turns = [(t[:3], t), ("user", t[::-1])]
        assert [(a, b) for a, b, _, _ in chat_format.parsed(chat_format.marked(turns))] == turns


def cut(x, template):
    return [(r, template.unescape(x.output[a:b])) for r, (a, b) in zip(x.roles, x.texts, strict=True)]


def bracketed(turns):
    """A second template, which parsed() can't read: a preamble, headers of one character, counted turns, doubled slashes."""
    return "#" + "".join(f"{r[:1].upper()}{i % 2}>{t.replace('/', '//')}/;" for i, (r, t) in enumerate(turns))


def test_rendering_finds_spans_and_rewrites():
    r = random.Random(4)
    bits = ["<", "|im_end|>", "<|im_end|>", "0", "1", "/", "/;", "\\", "\n", "a", "[INST]", "A>", "U0>", "é😀"]
    black = chat_format.Template(bracketed, lambda t: t.replace("//", "/"))
    for _ in range(150):
        turns = [(r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randint(0, 6)))) for _ in range(r.randint(0, 9))]
        for template in (chat_format.MARKED, black):
            x = chat_format.rendered(turns, template)
            assert not x.rewrites and "".join(x.output[a:b] for a, b in x.spans) == x.output[len(template.render([])) :]
            assert cut(x, template) == turns
    assert [(a, b) for a, b, *_ in chat_format.parsed(chat_format.rendered(turns).output)] == turns


def test_rewritten_history_is_found_at_any_depth():
    turns = [("user", f"t{i}" * (i + 1)) for i in range(40)]
    forgetful = chat_format.Template(lambda ts: "".join(f"[{r}]{t if i >= len(ts) - 2 else ''}" for i, (r, t) in enumerate(ts)))
    x = chat_format.rendered(turns, forgetful)
    assert x.rewrites == list(range(2, 40)) and x.texts[:38] == [(-1, -1)] * 38 and cut(x, forgetful)[38:] == turns[38:]
    # The thirtieth turn alone changes the first one.
    late = chat_format.Template(lambda ts: "".join(f"[{r}]{'-' if len(ts) >= 30 and not i else t}" for i, (r, t) in enumerate(ts)))
    x = chat_format.rendered(turns, late)
    assert x.rewrites == [29] and x.texts[0] == (-1, -1) and cut(x, late)[1:] == turns[1:]


def test_a_long_conversation_is_rendered_whole():
    """More output by prefixes than the 32 million characters at which it once changed its way."""
    turns = [(("user", "assistant")[i % 2], f"{i} " * 60 + "<s>") for i in range(800)]
    x = chat_format.rendered(turns)
    assert sum(b for _, b in x.spans) > 32_000_000 and not x.rewrites and cut(x, chat_format.MARKED) == turns


def test_loss_is_cut_from_spans(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"a/{i}/;") for i in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # Workers have no tests to import, so the template goes by value.
    template = chat_format.Template(lambda ts: "#" + "".join(f"{r[:1].upper()}{i % 2}>{t.replace('/', '//')}/;" for i, (r, t) in enumerate(ts)), lambda t: t.replace("//", "/"))
    out = chat_format.loss_digest(chat_format.format_chats(df, template), unescape=template.unescape).first()
    want = "".join(t for *_, r, t in rows if r == "assistant")
    assert out["loss_chars"] == len(want) and out["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert out["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in rows).encode()).hexdigest()


def test_chats_odd(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, "x"), (2, 0, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    out = {r["conv"]: r for r in chat_format.loss_digest(chat_format.format_chats(df)).collect()}
    assert {k: v["n_turns"] for k, v in out.items()} == {1: 3, None: 1, 2: 1} and out[1]["loss_chars"] == 2
    assert chat_format.loss_digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_network_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = quality_cnn.train(docs, labels)
    out = quality_cnn.score(docs.select("doc_id", "text"), net).join(labels, "doc_id").where(quality_cnn.held_out("doc_id")).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"])
    good = out[out.quality == 1].score.mean() - out[out.quality == 0].score.mean()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() >= 0.9 and good > 0.3


def test_network_reads_every_byte():
    net = quality_cnn.initial(1)
    tables = net.pairs()
    data = bytes(random.Random(0).randrange(32, 126) for _ in range(200_000))
    halves = quality_cnn.half_maxima(tables, quality_cnn.padded(data), len(data))
    raw = np.frombuffer(data + bytes(quality_cnn.WIDTH), np.uint8)
    slow = sum(net.conv[j][raw[j : j + len(data)]] for j in range(quality_cnn.WIDTH))
    want = np.stack([slow[i : i + quality_cnn.HALF].max(axis=0) for i in range(0, len(data), quality_cnn.HALF)])
    assert np.allclose(halves, want, atol=1e-5)


def test_gradient_of_whole_texts():
    """Against differences of the loss, of all parameters, over a text of several chunks."""
    net, data = quality_cnn.initial(3), bytes(random.Random(1).randrange(32, 126) for _ in range(1500))
    for p in range(6):
        setattr(net, ("conv", "bias", "w1", "b1", "w2", "b2")[p], net.params()[p].astype(np.float64))
    loss = lambda: -np.log(quality_cnn.probability(net, net.pairs(), data.decode()))
    grads = [np.zeros_like(p) for p in net.params()]
    quality_cnn._add_gradient(net, data, 1, grads)
    r = random.Random(2)
    for g, p in zip(grads, net.params(), strict=True):
        for at in [*np.argwhere(g != 0)[:: max(1, (g != 0).sum() // 5)], [r.randrange(n) for n in p.shape]]:
            at, was = tuple(at), p[tuple(at)]
            p[at] = was + 1e-6
            up = loss()
            p[at] = was - 1e-6
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_network_odd(spark, odd, none):
    net = quality_cnn.initial(1)
    assert quality_cnn.score(odd, net).count() == odd.count() and quality_cnn.score(none, net).count() == 0
    assert 0 <= quality_cnn.probability(net, net.pairs(), None) <= 1


def test_tokens_like_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    r = random.Random(4)
    vocab = [("▁", -2.0)] + [(w, float(-r.randint(1, 6))) for w in sorted({"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(60)} - {"▁"})]
    vocab += [(c, -3.0) for c in "ab" if c not in dict(vocab)]
    big = token_counts.vocabulary(token_counts.default_vocabulary_path())
    for v in (vocab, big):
        lib = Tokenizer(models.Unigram([*v, ("<unk>", 0.0)], len(v), False))
        lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)])
        counter = token_counts.Counter(v)
        for _ in range(1500):
            t = "".join(r.choice("abcdxé日 \n\x1c\u2003😀") for _ in range(r.randint(0, 20)))
            assert counter.text(t)[0] == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_tokens_odd(spark, odd, none):
    out = token_counts.count_tokens(odd).collect()
    assert len(out) == odd.count() and token_counts.count_tokens(none).count() == 0
    assert {r["n_tokens"] for r in out if r["doc_id"] in (None, 1, 2)} == {0}


def test_warc_round_trip_and_audit(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 50)) for i in range(9000)] + [(7, "dup", "dup"), (None, None, None), (None, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    recs = warc_fixity.records(pages)
    (content,) = warc_fixity.containers(recs.where("id < 100")).select("content").first()
    found = list(warc_fixity.parse(bytes(content)))
    assert len(found) == 101 and found[1][0] == found[0][1] and found[5][3] == ("é" * 5).encode()
    a = warc_fixity.tree(recs, "t-a")
    same = warc_fixity.tree(warc_fixity.records(pages.repartition(5)), "t-b")
    assert warc_fixity.audit(a, same).count() == 0
    bad = pages.where("coalesce(page_id, -1) <> 4500").withColumn("html", F.when(F.col("page_id") == 8000, "x").otherwise(F.col("html")))
    bad = bad.union(spark.createDataFrame([(9500, "new", "new")], bad.schema))
    out = {(r["key"], r["kind"]) for r in warc_fixity.located(a, warc_fixity.tree(warc_fixity.records(bad), "t-c")).collect()}
    assert out == {(4500, "missing"), (8000, "changed"), (9500, "extra")}


def test_equal_nodes_end_the_descent(spark):
    """No leaf is read below equal roots, and below a mismatch only the pages of its file."""
    pages = spark.range(9000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "'b' AS html", "1 AS key", "2 AS digest")
    a, b = (warc_fixity.tree(warc_fixity.records(pages), f"t-{k}") for k in "de")
    unread = lambda t, ok: [t[0].where(f"CASE WHEN {ok} THEN true ELSE raise_error('read') END"), *t[1:]]
    assert warc_fixity.audit(unread(a, "false"), unread(b, "false")).count() == 0
    bad = pages.withColumn("html", F.when(F.col("page_id") == 5000, "x").otherwise("b"))
    c = warc_fixity.tree(warc_fixity.records(bad), "t-f")
    near = "key >= 4096 AND key < 8192"  # the pages of its file
    assert [r["key"] for r in warc_fixity.audit(unread(a, near), unread(c, near)).collect()] == [5000]


def test_audit_of_negative_places_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(warc_fixity, "NULL_PLACES", 500)
    schema = "page_id long, url string, html string"
    rows = [(i, f"http://x/{i}", "b") for i in range(300)] + [(None, f"http://n/{i}", "b") for i in range(90)]
    of = lambda r: warc_fixity.tree(warc_fixity.records(spark.createDataFrame(r, schema)), "t-g")
    a = of(rows)
    assert warc_fixity.audit(a, of(rows[::-1])).count() == 0
    lost = warc_fixity.located(a, of(rows[:-1])).collect()
    assert len(lost) == 1 and lost[0]["key"] < 0 and lost[0]["kind"] in ("missing", "changed")
    none = of([])
    assert warc_fixity.audit(none, none).count() == 0 and warc_fixity.audit(none, of([])).count() == 0
    assert {r["kind"] for r in warc_fixity.located(a, none).collect()} == {"missing"}
    assert {r["kind"] for r in warc_fixity.located(none, a).collect()} == {"extra"}
    assert warc_fixity.located(a, none).count() == a[0].count()


def test_packed_files_are_read(spark, tmp_path):
    pages = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "repeat('é', cast(id AS int)) AS html")
    (content,) = warc_fixity.containers(warc_fixity.records(pages)).select("content").first()
    (tmp_path / "a.warc").write_bytes(content)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(content)[o : o + n]) for o, n, _, _ in warc_fixity.parse(bytes(content))))
    out = [(r["id"], r["offset"], bytes(r["record"])) for r in warc_fixity.read_records(spark, str(tmp_path)).orderBy("file", "id").collect()]
    assert len(out) == 40 and out[:20] == out[20:]


def brute(docs, n, num, den):
    sets, parent = {}, {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and den * k >= num * (len(sets[a]) + len(sets[b]) - k):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 9, 10)])
def test_join_like_brute_force(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "FIRST_PORTION", 1)
    r = random.Random(n)
    vocab = [f"v{i}" for i in range(400)]
    docs, base = [], []
    for i in range(260):
        if i % 4 == 0 or not base:
            base.append([r.choice(vocab) for _ in range(r.choice([1, 3, 5, 8, 20, 60, 200]))])
        w = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, " ".join(w) if i % 50 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(df, jaccard_join.Measure(n, num, den)).collect()}
    assert out == brute(docs, n, num, den)


def test_a_shared_part_is_certain():
    r = random.Random(9)
    m = jaccard_join.Measure(4, 85, 100)
    for _ in range(400):
        size = r.choice([6, 7, 12, 13, 30, 100, 500, 3000])
        s = {r.getrandbits(64) for _ in range(size)}
        t = set(s)
        while True:
            u = set(t)
            if r.random() < 0.5:
                u.discard(next(iter(u)))
            else:
                u.add(r.getrandbits(64))
            if 100 * len(u & s) < 85 * len(u | s):
                break
            t = u
        a, b = (np.array(sorted(x), np.uint64) for x in (s, t))
        assert s == t or set(jaccard_join.keys_of(a, m)) & set(jaccard_join.keys_of(b, m))
        w = jaccard_join.folded([jaccard_join.bits_of(a), jaccard_join.bits_of(b)])
        assert np.bitwise_count(w[0] ^ w[1]).sum() <= len(s ^ t) <= m.differ(len(s), len(t))


def test_join_odd(spark, odd, none):
    m = jaccard_join.Measure(4, 85, 100)
    out = jaccard_join.join(odd, m).collect()
    assert len(out) == odd.count() and jaccard_join.join(none, m).count() == 0
    assert {r["component_id"] for r in out if r["doc_id"] == 3} == {3} and all(r["n_shingles"] == 0 for r in out if r["doc_id"] in (None, 1, 2))


def rows_brute(rows, n, num, den):
    """(id, text, n_shingles, component_id) of rows that may share ids."""
    found = brute(list(enumerate(t for _, t in rows)), n, num, den)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(found[k][1], []).append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, found[k][0], least[found[k][1]] if found[k][0] else i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_join_with_null_and_repeated_ids(spark, kind):
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(60)] for _ in range(8)]
    rows = []
    for k in range(90):
        w = list(base[k % 8])
        for _ in range(k % 4):
            w[r.randrange(60)] = r.choice(vocab)
        i = None if k % 5 == 0 else (k * 7) % 23
        rows.append((i if i is None or kind == "long" else f"id{i}", " ".join(w) if k % 30 else ("" if k else None)))
    rows += [(None, " ".join(base[0])), (None, " ".join(base[1])), rows[7], rows[7]]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").selectExpr("*", "1 AS n", "2 AS c", "3 AS keys", "4 AS component_id", "5 AS t")
    out = jaccard_join.join(df, jaccard_join.Measure(4, 85, 100)).collect()
    assert sorted((tuple(x) for x in out), key=repr) == rows_brute(rows, 4, 85, 100)


def test_join_where_one_id_has_near_copies(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    for rows in ([(1, a), (2, a + " x"), (2, b), (3, "c")], [(None, a), (None, a + " x"), (None, b), (None, b + " y")]):
        out = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Measure(4, 85, 100)).collect()
        assert sorted((tuple(x) for x in out), key=repr) == rows_brute(rows, 4, 85, 100)


def test_join_of_one_hot_key(spark, monkeypatch):
    """Many sets that share one part of their hash range and don't link: more rows of tiles than a task is meant to have."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 50)
    common = [f"c{i}" for i in range(30)]
    docs = [(i, " ".join([*common, *(f"u{i}-{k}" for k in range(i % 12))])) for i in range(150)]
    out = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string"), jaccard_join.Measure(4, 85, 100)).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute(docs, 4, 85, 100)
