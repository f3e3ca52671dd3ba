"""Sharding, chat formatting and page extraction."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat_format, html_text, kd_shards
from tessella.llm.registry import QUERIES

from . import made

# -------------------------------------------------------------------- sharding


@pytest.fixture(scope="module")
def sharded(spark):
    rng = random.Random(1)
    rows = [(i, made.prose(rng, rng.randrange(0, 60)), f"s{min(i % 7, 2)}") for i in range(600)]
    rows += [(1000 + i, "the same text", "s0") for i in range(300)] + [(5000 + i, t) for i, t in enumerate(made.odd_texts(rng)) if len(t or "") < 700]
    rows += [(7, "repeated row"), (7, "repeated row"), (None, "no id")]
    docs = made.documents(spark, rows)
    return rows, kd_shards.assign(docs, kd_shards.document_dims(), shards=16).collect()


def test_bytes_of_shards_are_near_equal(sharded):
    rows, got = sharded
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    by = defaultdict(int)
    for r in got:
        by[r.shard] += r["size"]
    assert sorted(by) == list(range(16)) and len(got) == len(rows)
    assert max(by.values()) - min(by.values()) <= 2 * longest
    assert max(by.values()) < total / 16 + longest


def test_sizes_checksums_and_slots(sharded):
    rows, got = sharded
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_splits_follow_the_widest_dimension(spark):
    rows = [(i, "x" * 9, "s") for i in range(64)]
    docs = made.documents(spark, rows)
    got = kd_shards.assign(docs, {"id": F.col("doc_id"), "flat": F.lit(1)}, shards=4).collect()
    assert all(r.shard == r.doc_id // 16 for r in got)


def test_cuts_are_weighted_medians_of_the_widest_dimension(spark):
    """Every node of a mixed table beside plain Python: which dimension is widest, and
    that no other cut on it leaves the halves nearer to equal."""
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), "x" * rng.randrange(200), rng.randrange(1000), rng.choice([None, rng.random() ** 3])) for _ in range(500)]
    rows += rows[:30] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, p long, q double").repartition(4)
    # the place in the collection tells rows apart in the result
    dims = {"p": F.col("p"), "q": F.col("q"), "flat": F.lit(3)}
    df = df.withColumn("doc_id", F.col("p") * 10_000 + F.coalesce(F.round(F.col("q") * 9000).cast("long"), F.lit(9999)))
    got = kd_shards.assign(df, dims, shards=8).collect()
    low = [min(r[i] for r in rows if r[i] is not None) for i in (2, 3)]
    high = [max(r[i] for r in rows if r[i] is not None) for i in (2, 3)]
    by_id = {}
    for _, _, p, q in rows:
        i = p * 10_000 + (9999 if q is None else int(np.floor(q * 9000 + 0.5)))
        by_id[i] = [0 if v is None else int((v - low[k]) * (kd_shards.TOP / (high[k] - low[k]))) for k, v in enumerate((p, q))]
    points = [(by_id[r.doc_id], r["size"], r.shard) for r in got]
    for depth in range(3):
        for node in range(2**depth):
            inside = [(k, size, shard >> (2 - depth) & 1) for k, size, shard in points if shard >> (3 - depth) == node]
            width = [max(k[d] for k, *_ in inside) - min(k[d] for k, *_ in inside) for d in (0, 1)]
            d = int(width[1] > width[0])
            left, right = ([k[d] for k, _, side in inside if side == s] for s in (0, 1))
            assert max(left) <= min(right)
            weight = [sum(size for _, size, side in inside if side == s) for s in (0, 1)]
            at_cut = [size for k, size, _ in inside if k[d] in (max(left), min(right))]
            assert abs(weight[0] - weight[1]) <= max(at_cut)


def test_equal_rows_are_spread(spark):
    rows = [(i, "y" * 40, "s") for i in range(6000)] + [(None, "z" * 16, "s")] * 3000
    got = kd_shards.assign(made.documents(spark, rows), kd_shards.document_dims(), shards=16).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 4 * 41
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_nested_loop_joins(spark, sf):
    plan = QUERIES["op3_kd_shards"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_target_bytes_set_the_depth(spark):
    docs = made.documents(spark, [(i, "x" * 99, "s") for i in range(40)])
    sizes = defaultdict(int)
    for r in kd_shards.assign(docs, {"id": F.col("doc_id")}, target_bytes=1100).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 4 and max(sizes.values()) <= 1100
    assert kd_shards.assign(docs.where("false"), kd_shards.document_dims(), shards=4).count() == 0


# ---------------------------------------------------------------- chat format


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["\\", "#", "###", "</turn>", "<", "/turn>", "a", ":", " ", "\n"]) for _ in range(rng.randrange(12)))
        role = rng.choice(["user", "assistant", "a: b", "###", "", "x\ny"])
        span = chat_format.marked_turns([(role, t)])
        assert chat_format.unescape(chat_format.escape(t)) == t and chat_format.read_turn(span) == (role, t)


def test_spans_and_mask():
    turns = [("system", "s"), ("user", chat_format.HOSTILE), ("assistant", ""), ("assistant", "ok </turn>"), ("user", "")] * 5
    got = chat_format.format_conversation(turns)
    assert got["rewritten"] is None and [a for a, _ in got["spans"][1:]] == [z for _, z in got["spans"][:-1]]
    assert [chat_format.read_turn(got["output"][a:z]) for a, z in got["spans"]] == turns
    assert [chat_format.unescape(got["output"][a:z]) for a, z in got["mask"]] == [t for r, t in turns if r == "assistant"]


def test_templates_that_rewrite_history_are_detected():
    def forgets(turns):  # earlier answers are shortened once more turns follow
        return "".join(f"<{r}>{t if i + 1 == len(turns) else t[:3]}\n" for i, (r, t) in enumerate(turns))

    def closes(turns):  # a suffix after the last turn
        return "".join(f"<{r}>{t}\n" for r, t in turns) + "<end>"

    def late(turns):  # another header once the conversation is long
        return ("long\n" if len(turns) > 7 else "short\n") + "".join(f"<{r}>{t}\n" for r, t in turns)

    def six(turns):  # another header while there are exactly six turns
        return ("six\n" if len(turns) == 6 else "") + "".join(f"<{r}>{t}\n" for r, t in turns)

    def numbered(turns):  # depends on the place, but never rewrites
        return "".join(f"{i}<{r}>{t}\n" for i, (r, t) in enumerate(turns))

    turns = [("user", "question"), ("assistant", "answer")] * 5
    assert chat_format.locate(forgets, turns)[2] == 1
    assert chat_format.locate(closes, turns)[2] is not None
    assert chat_format.locate(late, turns)[2] == 7
    assert chat_format.locate(six, turns)[2] == 5
    output, spans, rewritten = chat_format.locate(numbered, turns)
    assert rewritten is None and "".join(output[a:z] for a, z in spans) == output


def test_conversations(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, "###"), (1, 2, None, "###"), (2, None, "assistant", "é\U0001f600"),
        (2, 5, "assistant", "</turn>"), (None, 0, "user", "x"), (3, 0, "user", "y" * 100_000),
    ]
    df = spark.createDataFrame([(*r, 0, "o") for r in rows], "conv_id long, turn long, role string, text string, n_turns int, output string").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("user\n\nassistant\nb\n\n###\n\n###\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (1, sha("b"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (9, sha("é\U0001f600</turn>"))
    assert got[None].n_turns == 1 and got[3].loss_chars == 0 and got[3].formatted_chars == 100_000 + 18
    assert chat_format.read_chats(chat_format.format_chats(df.where("false"))).count() == 0


# ------------------------------------------------------------- page extraction


def test_broken_pages_take_one_pass():
    import time

    broken = ["<a " * 300_000, "<div><b>t</b>" * 40_000, '<a "' * 200_000, "<b><div>" * 60_000 + "x", "<div>" * 60_000 + "<li>x" * 30_000, "<!-" * 200_000, "</x" * 300_000 + ">",
              "<script>" * 100_000, '<p title=">' * 100_000]
    for html in broken:
        start = time.perf_counter()
        html_text.blocks(html)
        assert time.perf_counter() - start < 20  # a second or two; the square would be hours
    assert [b.text for b in html_text.blocks("<p>one<p>two <a")] == ["one", "two <a"]
    assert [b.text for b in html_text.blocks("a <!-- never closed <p>b")] == ["a"]
    assert [b.text for b in html_text.blocks("<p title='x>one<p>two")] == ["one", "two"]


def test_blocks():
    page = html_text.blocks(
        "<html><head><title>T &amp; U</title><script>if (a<b) '</p>'</script><style>p{}</style></head><body><!-- <p>no</p> -->"
        "<article class='post main-text'><h1>A  &lt;b&gt;\n c</h1><p>one<b>two</b> three<br>four<p>five &copy &#x41;<ul><li>x<li>y</ul>"
        '<p title="a>b">six <a href=#>se</a>ven</article>tail < 3 <footer>f'
    )
    assert [b.text for b in page] == ["T & U", "A <b> c", "onetwo three four", "five © A", "x", "y", "six seven", "tail < 3", "f"]
    assert page[1].path == (("html",), ("body",), ("article", "post", "main", "text"), ("h1",))
    assert page[5].path[-2:] == (("ul",), ("li",)) and page[6].linked == 2
    assert html_text.blocks("") == [] and html_text.blocks("plain") [0].text == "plain"


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 2, html_text.DIMS)).astype(np.float32)
    mask = np.array([[1, 1], [1, 1], [1, 1], [1, 0], [1, 0]], np.float32)
    w = {k: v.astype(np.float64) for k, v in html_text.new_weights(rng).items()}
    loss = lambda: (html_text._run(x, mask, w, "f")[0].astype(np.float64) * mask[:, :, None]).sum()
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    _, tape = html_text._run(x, mask, w, "f", True)
    html_text._back(x, mask, w, "f", tape, np.repeat(mask[:, :, None], html_text.HIDDEN, 2), grads)
    for name, at in (("fx", (3, 5)), ("fh", (2, 20)), ("fc", (40,))):
        old = w[name][at]
        w[name][at] = old + 1e-2
        up = loss()
        w[name][at] = old - 1e-2
        down = loss()
        w[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at]))


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def test_articles_are_found_exactly(spark, pages):
    import html
    import re

    odd = [(-1, "u", None), (-2, "u", ""), (-3, None, "<p"), (-4, "u", "<nav><a href=x>Menu</a></nav>")]
    extra = spark.createDataFrame(odd, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages.unionByName(extra).withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL).group(1)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert [got[-k].text for k in (1, 2, 4)] == ["", "", ""]
    assert html_text.extract(pages.where("false")).count() == 0


def test_held_out_layouts(pages):
    sample = [r.html for r in pages.orderBy("page_id").limit(80).collect()]
    weights = html_text.fit(sample[:40])
    rng = np.random.default_rng(123)
    texts = [b.text for h in sample[40:] for b in html_text.blocks(h) if len(b.text) > 40]
    right = total = 0
    for _ in range(150):
        page = html_text.blocks(html_text.made_up_page(rng, texts))
        y = np.array([b.text.startswith(html_text._MARK) for b in page])
        for b in page:
            b.text = b.text.removeprefix(html_text._MARK) or "x"
        right += ((html_text.scores([html_text.features(page)], weights)[0] > 0.5) == y).sum()
        total += len(y)
    assert right / total > 0.99
