"""The operators against brute force on small fixtures with nulls, empty and long texts, repeats and clashing columns."""

import gzip
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm import common, components, decontaminate, exact_dedup, licenses, mixing, quality, sharding, simhash, suffix, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, keep_id long, _score double, mark long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "the of tax levy county Élan über niño board state water fish road plan vote rate code title part".split()


def texts():
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 99)) for _ in range(n))
    base = [prose(rnd.randint(5, 120)) for _ in range(30)]
    shared = prose(60)
    out = [*base, *base[:6], base[0], None, None, "", "", "a", "  \t\n ", prose(4000)]
    out += [x + " " + shared + " " + prose(20) for x in base[6:12]] + [base[12].replace("tax", "taxes", 1)] + ["ab " * 300, "In. " * 200, "x" * 500]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, "en", ["s1", "s2", None, "s10"][min(i % 7, 3)], len(t or ""), 1, 2, 3.0, 4) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def components_by_force(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 1


def test_suffixes_and_common_prefixes(tmp_path):
    rnd = random.Random(1)
    for case in range(250):
        text = bytes(rnd.choice(rnd.choice([b"a", b"ab", b"abcd", bytes(range(256))])) for _ in range(rnd.randint(1, 80)))
        text = (text + text[: rnd.randint(1, 30)] * rnd.randint(0, 4))[:300]
        cap = rnd.choice([2, 9, 200])
        folder = tmp_path / str(case)
        folder.mkdir()
        order, lcp = suffix.sorted_suffixes(np.frombuffer(text, np.uint8), cap, suffix.Scratch(str(folder), rnd.choice([8, 10**9]), rnd.choice([64, 10**9]), rnd.choice([3, 17, 10**6]), rnd.choice([1, 5, 10**6])))
        assert sorted(order.tolist()) == list(range(len(text)))
        for i in range(1, len(text)):
            a, b = text[order[i - 1] :], text[order[i] :]
            shared = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert a[:cap] <= b[:cap] and lcp[i] == min(cap, shared)


LIMITED = """
import resource, sys
import numpy as np
from docketry.llm import suffix
rnd = np.random.default_rng(5)
words = [bytes(rnd.integers(97, 123, rnd.integers(2, 9), np.uint8)) for _ in range(3000)]
n = int(sys.argv[2])
text = np.memmap(sys.argv[1] + "/text", np.uint8, "w+", shape=(n,))
for a in range(0, n, 1 << 16):
    part = b" ".join(words[i] for i in rnd.integers(0, 3000, 20000))[: min(1 << 16, n - a)]
    text[a : a + len(part)] = np.frombuffer(part, np.uint8)
held = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmData")) << 10
resource.setrlimit(resource.RLIMIT_DATA, (held + int(sys.argv[3]), held + int(sys.argv[3])))
scratch = suffix.Scratch(sys.argv[1], 1 << 16, 1 << 20, 1 << 15, 200_000)
done, last = 0, None
for at, lcp in suffix.suffix_chunks(text, 256, 200, scratch):
    for i in range(0, len(at), 997):
        if i:
            a, b = (bytes(text[p : p + 200]) for p in at[i - 1 : i + 1])
            assert a <= b and lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    done += len(at)
assert done == n
"""


def test_a_shard_larger_than_memory_is_sorted(tmp_path):
    """Arrays in memory would take over 20 bytes for each byte of the text; the limit leaves 20 in all."""
    n, limit = 1 << 20, 20 << 20
    ran = subprocess.run([sys.executable, "-c", LIMITED, str(tmp_path), str(n), str(limit)], cwd=Path(__file__).parents[2], capture_output=True, text=True, env={"OPENBLAS_NUM_THREADS": "1", "PATH": "/usr/bin"})
    assert ran.returncode == 0, ran.stderr[-2000:]


def cut_by_force(every, span=200):
    raws = [(t or "").encode() for t in every]
    seen = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_strings_go(docs, rows, hot):
    got = by_id(suffix_dedup.repeated_spans(docs, hot=hot))
    for r, expected in zip(rows, cut_by_force([r[1] for r in rows]), strict=True):
        g = got[r[0]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == expected


def test_repeated_rows_are_copies_and_empty_tables_give_nothing(spark, nothing):
    twice = spark.createDataFrame([(1, "y" * 250), (1, "y" * 250), (None, "z" * 10)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.dedup_documents(twice).collect()) == [0, 250, 250]
    assert suffix_dedup.dedup_documents(nothing).collect() == []


def test_many_equal_rows_are_looked_at_once(spark, monkeypatch):
    """Rows that repeat id and text, or text alone, and one that shares a string with them."""
    rnd = random.Random(8)
    boiler = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    own = "".join(rnd.choice("xyz ") for _ in range(400))
    rows = [(None, boiler)] * 3000 + [(7, boiler)] * 50 + [(8, boiler), (9, own + boiler[500:900]), (10, own[:190])]
    cut = []
    ranges = suffix_dedup.sorted_ranges
    monkeypatch.setattr(suffix_dedup, "sorted_ranges", lambda contexts: (cut.append(contexts.count()), ranges(contexts))[1])
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert {(r["n_removed"], r["n_spans"]) for r in got if r["n_bytes"] == 3000} == {(3000, 1)}
    (mixed,) = (r for r in got if r["doc_id"] == 9)
    assert mixed["spans"][0].asDict() == {"a": 400, "b": 800} and mixed["kept_sha256"] == hashlib.sha256(own.encode()).hexdigest()
    assert cut[0] < 100


# 2


def test_warc_derivatives(spark):
    html = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- c --><script>x</script><p>One<br>two &lt;3</p><div><a href="/x?a=1&amp;b=2">go</a></div></body></html>'
    pages = spark.createDataFrame([(1, "http://e.org/", html), (2, None, None), (3, "http://e.org/3", "")], "page_id long, url string, html string")
    made = {(r["source_id"], r["record_type"]): r for r in warc.derivatives(warc.responses(pages)).collect()}
    assert len(made) == 6
    text, meta = made[1, "conversion"], made[1, "metadata"]
    assert text["payload"] == "One\ntwo <3\ngo" and text["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert meta["payload"].split("\r\n")[0] == "title: A & B" and meta["payload"].endswith("outlink: /x?a=1&b=2") and "source-header: content-type" in meta["payload"]
    assert text["refers_to"] == meta["refers_to"] != text["record_id"] and made[2, "conversion"]["payload"] == ""
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []


def test_warc_files_round_trip(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    raw = warc.warc_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<a>"}, b"x") + warc.warc_bytes({"WARC-Type": "response", "WARC-Record-ID": "<b>", "WARC-Target-URI": "http://e/"}, block)
    (tmp_path / "a.warc").write_bytes(raw)
    got = warc.derivatives(warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path)))).collect()
    assert {(r["refers_to"], r["target_uri"], r["source_headers"]) for r in got} == {("<b>", "http://e/", "Content-Type: text/html")} and len(got) == 2
    warc.write_derivatives(warc.derivatives(warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path)))), str(tmp_path / "out"))
    back = [(f, block) for file in (tmp_path / "out").glob("part-*") for f, block in warc.parse_warc(file.read_bytes())]
    assert {f["warc-refers-to"] for f, _ in back} == {"<b>"} and sorted(f["warc-type"] for f, _ in back) == ["conversion", "metadata"]
    assert all(f["warc-payload-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() for f, block in back)


def test_warc_keeps_dates_and_digests_and_reads_encodings(spark, tmp_path):
    page = "<p>Größe &#233; &#x20AC; &copy; &unknown; &amp;lt;</p><nav>menu</nav>"
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (page[:9].encode("latin-1"), page[9:].encode("latin-1"))) + b"0\r\n\r\n"
    bodies = [
        (b"Content-Type: text/html; charset=ISO-8859-1\r\nTransfer-Encoding: chunked", chunked),
        (b"Content-Type: text/html\r\nContent-Encoding: gzip\r\nX-Of: two", gzip.compress(page.encode())),
        (b"Content-Type: text/html; charset=nonsense\r\nContent-Encoding: gzip", page.encode()),
    ]
    raw = b""
    for i, (head, body) in enumerate(bodies):
        told = {"WARC-Payload-Digest": "sha1:OWN"} if i == 1 else {}
        raw += warc.warc_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "WARC-Date": "2026-01-02T03:04:05Z", "WARC-Target-URI": "http://e/", **told}, b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + body)
    (tmp_path / "a.warc").write_bytes(raw)
    got = {(r["refers_to"], r["record_type"]): r for r in warc.derivatives(warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path / "a.warc")))).collect()}
    assert {r["payload"] for (_, kind), r in got.items() if kind == "conversion"} == {"Größe é € © &unknown; &lt;\nmenu"} and {r["date"] for r in got.values()} == {"2026-01-02T03:04:05Z"}
    assert [got[f"<{i}>", "conversion"]["source_digest"] for i in range(3)] == ["sha256:" + hashlib.sha256(chunked).hexdigest(), "sha1:OWN", "sha256:" + hashlib.sha256(page.encode()).hexdigest()]
    assert "source-header: X-Of: two" in got["<1>", "metadata"]["payload"].split("\r\n")


def test_warc_repeats_long_pages_and_clashing_columns(spark):
    html = '<a href=/bare>x</a><a href="/o\'brien">y</a><a class=c href=\'/q"\'>z</a>' + "<p>word</p>" * 20_000
    pages = spark.createDataFrame([(1, "u", html, 1, "x"), (1, "u", html, 2, "y"), (None, None, None, 3, "z")], "page_id long, url string, html string, payload long, headers string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 6 and Counter(r["record_id"] for r in made if r["source_id"] == 1).most_common(1)[0][1] == 2
    meta = next(r for r in made if r["source_id"] == 1 and r["record_type"] == "metadata")
    assert [x for x in meta["payload"].split("\r\n") if x.startswith("outlink")] == ["outlink: /bare", "outlink: /o'brien", 'outlink: /q"']
    assert all(r["payload"].count("word") == 20_000 for r in made if r["source_id"] == 1 and r["record_type"] == "conversion")


# 3 and 9


def test_trees_learn_and_walk_like_the_tree():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = x[2000]
    total = model.base
    for t in range(len(model.left) // model.size):
        at = t * model.size
        while model.left[at] >= 0:
            at = model.left[at] + (one[model.feature[at]] > model.threshold[at])
        total += model.value[at]
    assert math.isclose(model.score(x[2000:2001])[0], 1 / (1 + math.exp(-total)))
    assert quality.fit(x[:3], np.ones(3)).score(x).tolist() == [0.8] * len(x)


def test_the_first_split_is_the_best_of_all(spark):
    rnd = np.random.default_rng(7)
    x = rnd.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rnd.normal(size=300) > 6).astype(float)
    model = quality.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    grad, weight = y - p, np.full(len(y), p * (1 - p))
    score = lambda on: grad[on].sum() ** 2 / (weight[on].sum() + quality.RIDGE)
    gains = {(j, t): score(x[:, j] <= t) + score(x[:, j] > t) for j in range(4) for t in np.unique(x[:, j])[:-1]}
    best = max(gains.values())
    assert math.isclose(gains[model.feature[0], model.threshold[0]], best)
    left = x[:, model.feature[0]] <= model.threshold[0]
    for at, on in ((1, left), (2, ~left)):
        assert math.isclose(model.value[at], quality.RATE * grad[on].sum() / (weight[on].sum() + quality.RIDGE))


def test_statistics_of_texts():
    names = ["bytes", "words", "upper", "lower", "digits", "blanks", "lines"]
    got = dict(zip(names, quality.statistics("Aa bb bb 7\n."), strict=False))
    assert got == pytest.approx({"bytes": np.log1p(12), "words": np.log1p(5), "upper": 1 / 12, "lower": 5 / 12, "digits": 1 / 12, "blanks": 3 / 12, "lines": 1 / 12})
    assert quality.statistics(None) == quality.statistics("") and not any(quality.statistics("")) and len(quality.statistics("x y " * 50_000)) == len(quality.statistics(""))


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], int((r[1] or "").count(" ") > 40), int("tax" in (r[1] or ""))) for r in rows if r[0] % 2 == 0] + [(None, 1, 1), (10**9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,mod,held", [(quality, 5, 0), (toxicity, 3, 1)])
def test_scores_of_every_document(docs, rows, labels, nothing, module, mod, held):
    got = by_id(module.score_documents(docs, labels))
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == held) and r["predicted"] == int(r["score"] >= module.THRESHOLD) for i, r in got.items())
    assert module.score_documents(nothing, labels).collect() == [] and len(module.score_documents(docs, labels.limit(0)).collect()) == len(rows)


WORDS = dict.fromkeys(["idiot", "moron", "stupid", "loser", "scum", "trash"], 5.0)


@pytest.fixture(scope="module")
def model():
    return toxicity.Model(WORDS, toxicity.character_model(np.ones((toxicity.N,) * 3), WORDS))


@pytest.mark.parametrize("text,word", [("an 1d10t!", "idiot"), ("m0r0n", "moron"), ("s t u p i d", "stupid"), ("so l-o-s-e-r x", "loser"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("idi*t", "idiot"), ("tr@sh", "trash"), ("5cum", "scum"), ("I D I O T", "idiot"), ("trash/foo", "trash"), ("Stüpid.", "stupid")])
def test_hidden_words_are_restored(model, text, word):
    assert list(model.hits(text)[0]) == [word]


@pytest.mark.parametrize("token", ["d'idiot", "qu'idiot", "well-stupid", "no...idiot", "foo_idiot", "bof!idiot", "d\u2014idiot", "d\u2019idiot"])
def test_words_within_tokens_count_whatever_stands_around(model, token):
    (alone,) = model.hits(token)[0].items()
    assert alone == (token[-6:] if "stupid" in token else token[-5:], 1)
    assert model.hits(token + " x y z v")[0] == dict([alone])


@pytest.mark.parametrize("text", ["", None, "a b c d e", "plain prose of 12 words & 3.5%!!", "ldlot", "$100 4 u", "x" * 10_000, "*** ### $$$"])
def test_clean_text_is_left_alone(model, text):
    assert model.hits(text) == ({}, [])


def paths_by_force(model, token):
    """(cost, words) of every path through a token's lattice."""
    out = []

    def walk(i, state, cost, path):
        if i == len(token):
            out.append((cost + (model.cost[state][0] if state % toxicity.N else 0), path.strip()))
            return
        c, b = token[i], state % toxicity.N
        mark = c in "!|$+@" and not re.match("[a-z0-9]", token[i:].lstrip("!|$+@"))
        options = [] if mark else [(c, 0.0)] if c in toxicity.LETTERS else [(x, toxicity.SUBSTITUTED) for x in toxicity.STANDS_FOR.get(c, "")]
        for x, paid in options:
            k = toxicity.LETTERS.index(x) + 1
            walk(i + 1, b * toxicity.N + k, cost + paid + model.cost[state][k], path + x)
            if k == b:
                walk(i + 1, state, cost + paid + toxicity.REPEATED, path)
        if c not in toxicity.LETTERS:
            if b:
                walk(i + 1, state, cost + toxicity.SEPARATED + (toxicity.SUBSTITUTED if options else 0), path)
                walk(i + 1, b * toxicity.N, cost + model.cost[state][0], path + " ")
            else:
                walk(i + 1, state, cost, path)

    walk(0, 0, 0.0, "")
    return out


def test_decoding_finds_the_least_cost_of_all_paths(model):
    rnd = random.Random(8)
    tokens = ["1d10t", "$tup1d", "l-o-s-e-r", "iddioot", "b*g!", "a!!b", "", "!!", "s t u p i d"] + ["".join(rnd.choice("aabdiot10!$-* ") for _ in range(rnd.randint(1, 8))) for _ in range(150)]
    rnd = np.random.default_rng(3)
    other = toxicity.Model(WORDS, toxicity.character_model(rnd.integers(0, 50, (toxicity.N,) * 3).astype(float), WORDS))
    for m in (model, other):
        for token in tokens:
            cost, word = m.best(token)
            every = paths_by_force(m, token)
            assert math.isclose(cost, min(c for c, _ in every), abs_tol=1e-9) and any(w == word and math.isclose(c, cost, abs_tol=1e-9) for c, w in every)


def test_long_runs_and_texts_are_restored_whole(spark, model):
    assert model.hits("x y z " * 40 + " ".join("stupid") + " q w" * 30)[0] == {"stupid": 1}
    docs = spark.createDataFrame([(1, "An 1d10t, well: m0r0n!"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["restored"] for r in toxicity.restored_texts(docs, model).collect()} == {1: "an idiot wel moron", 2: "", 3: ""}


def test_an_id_that_repeats_teaches_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d e"), (2, "f"), (None, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for label in ("quality", "toxic"):
        own = quality.labelled(docs, labels, label, 7, 6, 10)
        got = quality.one_of_each_id(own.selectExpr("doc_id", "y", "array(double(length(text))) x")).collect()
        assert sorted(map(tuple, got)) == [(1, 1.0, [3.0]), (2, 0.0, [1.0])]
        assert len((quality if label == "quality" else toxicity).score_documents(docs, labels).collect()) == 4


def test_stems_and_score_agree_with_a_plain_version(spark):
    """Presence tells one stem, density another; measures and score of plain texts recomputed word by word."""
    rnd = random.Random(6)
    filler = ["board", "water", "plans", "roads", "county", "taxes"]
    rows = []
    for i in range(240):
        toxic = i % 4 == 0
        words = [rnd.choice(filler) for _ in range(60)]
        words[:1] = ["gloop"] if toxic and i % 8 == 0 else ["water"]
        share = 6 if toxic and i % 8 else rnd.choice([0, 0, 1])
        words[1 : 1 + share] = ["snarkles", "snarked", "snarkor"] * 2 if share > 1 else [rnd.choice(["snarkles", "snarked", "snarkor"]) for _ in range(share)]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    fitted = toxicity.train(docs, labels)
    assert list(fitted.words) == ["gloop"] and list(fitted.dense) == ["snark"]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    yes, no = sum(r[2] for r in train), sum(1 - r[2] for r in train)
    odds = lambda holds: math.log((sum(r[2] for r in train if holds(r[1].split())) + 0.5) / (yes + 1)) - math.log((sum(1 - r[2] for r in train if holds(r[1].split())) + 0.5) / (no + 1))
    limit = fitted.dense["snark"][1]
    gloop, snark = odds(lambda w: "gloop" in w), odds(lambda w: sum(x.startswith("snark") for x in w) * limit >= len(w))
    assert math.isclose(fitted.words["gloop"], gloop) and math.isclose(fitted.dense["snark"][0], snark)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    for i, text, _ in rows:
        w = text.split()
        g, k = w.count("gloop"), sum(x.startswith("snark") for x in w)
        dense = k * limit >= len(w) and k > 0
        x = [gloop * (g > 0), gloop * (g > 0), math.log1p(g), float(g > 0), 0.0, 100 * g / (1 + len(text) / 6), snark * dense, math.log1p(1000 * k / len(w))]
        assert math.isclose(got[i], 1 / (1 + math.exp(-min(30, max(-30, fitted.base + float(np.dot(x, fitted.weights)))))), rel_tol=1e-6)


def test_accuracy_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no tables")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = [r for r in toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").collect()]
    caught = [r["predicted"] for r in got if r["toxic"] == 1]
    clean = [1 - r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(caught) >= 0.9 * len(caught)


# 4


def test_shards(spark, docs, rows, nothing):
    a, b = sharding.shard_documents(docs).collect(), sharding.shard_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == len(rows)
    slots = defaultdict(list)
    text = {r[0]: r[1] or "" for r in rows}
    for r in a:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    many = spark.range(6000).selectExpr("id doc_id", "10L size").repartition(5)
    out = sharding.shuffled_shards(many, "doc_id", "size", shards=4, bucket_rows=100).collect()
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) < 1.2 * min(counts.values()) and sum(r["grown_shard"] == 4 for r in out) > 900
    for s in range(4):
        mine = sorted((r["slot"], r["doc_id"]) for r in out if r["shard"] == s)
        assert [x for x, _ in mine] == list(range(len(mine))) and abs(np.corrcoef([d for _, d in mine], range(len(mine)))[0, 1]) < 0.1
    assert sharding.shard_documents(nothing).collect() == []


def test_many_copies_of_a_record_lie_in_many_buckets(spark):
    rows = spark.range(900).selectExpr("if(id < 300, null, if(id < 600, 7, id)) doc_id", "if(id < 600, 'same', string(id)) text", "20L size")
    out = sharding.shuffled_shards(rows, "doc_id", "size", shards=3, bucket_rows=20).collect()
    again = sharding.shuffled_shards(rows.repartition(5), "doc_id", "size", shards=3, bucket_rows=20).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and Counter(r["doc_id"] for r in out)[None] == Counter(r["doc_id"] for r in out)[7] == 300
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    apart = sharding.told_apart(rows, 1, 20).selectExpr("record.doc_id", "h").collect()
    assert len(apart) == 900 and len({r["h"] for r in apart}) == 900


def test_rendezvous_and_order_agree_with_a_plain_version(spark):
    """XXH64 over the values, each seeded by the hash before it; ties can't be."""
    got = spark.range(200).selectExpr("id").withColumn("s", sharding.rendezvous(F.col("id"), 9)).collect()
    signed = lambda h: h - (h >> 63 << 64)

    def score(key, j):
        h = xxhash.xxh64((17).to_bytes(4, "little"), seed=42).intdigest()
        h = xxhash.xxh64(key.to_bytes(8, "little"), seed=h).intdigest()
        return signed(xxhash.xxh64(j.to_bytes(4, "little"), seed=h).intdigest())

    assert all(r["s"] == max(range(9), key=lambda j: score(r["id"], j)) for r in got)


def test_repeated_and_null_keys_get_slots(spark, tmp_path):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], "doc_id long, text string")
    got = sharding.shard_documents(same).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    sharding.write_shards(same.selectExpr("*", "5L size"), str(tmp_path / "out"), "doc_id", "size", shards=3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    sharding.write_shards(same.limit(0).selectExpr("*", "5L size"), str(tmp_path / "none"), "doc_id", "size", shards=3)
    assert not list((tmp_path / "none").glob("shard=*"))


def test_a_shard_is_written_by_buckets(spark, tmp_path):
    """Files of one shard hold buckets, slots rise in each, and together they are the shard."""
    rows = spark.range(3000).selectExpr("id doc_id", "10L size")
    sharding.write_shards(rows, str(tmp_path / "out"), "doc_id", "size", shards=2, bucket_rows=100)
    placed = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(rows, "doc_id", "size", shards=2, bucket_rows=100).collect()}
    for shard in (0, 1):
        files = [pq.read_table(f, columns=["doc_id", "slot"]).to_pydict() for f in (tmp_path / "out" / f"shard={shard}").glob("*.parquet")]
        assert len(files) > 5 and max(len(f["slot"]) for f in files) < 600 and all(f["slot"] == sorted(f["slot"]) for f in files)
        assert sorted(s for f in files for s in f["slot"]) == list(range(sum(len(f["slot"]) for f in files)))
        assert all(placed[d] == (shard, s) for f in files for d, s in zip(f["doc_id"], f["slot"], strict=True))


def test_warc_fields_and_status_lines_are_kept(spark, tmp_path):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>none</p>"
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<r>", "WARC-IP-Address": "192.0.2.1", "WARC-Truncated": "length", "WARC-Block-Digest": "sha1:x"}
    raw = b"".join(gzip.compress(warc.warc_bytes({**fields, "WARC-Concurrent-To": f"<c{i}>\r\nWARC-Concurrent-To: <d{i}>"}, block)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(raw + gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"))
    got = warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r["status"] for r in got] == ["HTTP/1.1 404 Not Found"] * 3
    assert got[1]["warc_fields"]["warc-ip-address"] == "192.0.2.1" and got[1]["warc_fields"]["warc-truncated"] == "length" and got[1]["warc_fields"]["warc-block-digest"] == "sha1:x" and got[1]["warc_fields"]["warc-concurrent-to"] == "<c1>\n<d1>"


# 5


def test_exact_groups(spark, docs, rows, nothing):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    for r in exact_dedup.exact_groups(docs).collect():
        text = next(x[1] or "" for x in rows if x[0] == r["doc_id"])
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[text]), len(groups[text]), r["doc_id"] == max(groups[text]), hashlib.sha256(text.encode()).hexdigest())
    hot = spark.range(5000).selectExpr("id doc_id", "if(id % 3 = 0, 'same', cast(id div 2 as string)) text")
    sizes = Counter(r["group_size"] for r in exact_dedup.exact_groups(hot).collect())
    assert sizes[1667] == 1667 and sum(sizes.values()) == 5000 and exact_dedup.exact_groups(nothing).collect() == []


# 6


def words_of(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_license_scan(spark, nothing):
    apache = "Licensed under the Apache License, Version 2.0."
    cases = {1: "Released under the MIT License. mit license", 2: apache, 3: "x " + "Licensed under CC BY-NC 4.0", 4: None, 5: "", 6: "license " * 400, 7: "This work is licensed under the GNU General Public License, version 3", 8: "permission mit apache gnu", 9: "under licensed the Apache"}
    got = by_id(licenses.scan_documents(spark.createDataFrame(list(cases.items()), "doc_id long, text string")))
    show = lambda i: tuple(got[i])[1:]
    assert show(1) == (7, 2, 3, 5, "mit", "mit", 1.0) and show(2) == (8, 1, 3, 3, "apache", "apache,apache-2.0", 1.0) and show(3)[5:] == ("cc-by-nc-4.0", 1.0)
    assert show(4) == show(5) == (0, 0, None, None, "", "", 0.0) and show(6) == (400, 0, None, None, "", "", 0.0)
    assert show(7)[4:6] == ("gpl", "gpl,gpl-3.0") and show(8)[5] == show(9)[5] == "" and licenses.scan_documents(nothing).collect() == []


def test_scans_of_repeats_long_texts_and_clashing_columns(spark):
    long = "word " * 30_000 + "Released under the MIT License" + " word" * 30_000
    rows = spark.createDataFrame([(1, long, "x", 5), (1, long, "y", 6), (None, "apache license", "z", 7)], "doc_id long, text string, _r string, _n_words int")
    got = [tuple(r)[1:] for r in licenses.scan_documents(rows).collect()]
    assert got.count((60_005, 1, 30_003, 30_003, "mit", "mit", 1.0)) == 2 and len(got) == 3
    assert {r["_r"] for r in licenses.scan(rows).collect()} == {"x", "y", "z"}


def test_exact_groups_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (1, "b"), (None, "b"), (None, None), (7, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(rows).collect())
    assert got == Counter([(None, None, 2, True)] * 2 + [(3, 3, 4, True)] * 2 + [(1, 3, 4, False), (None, 3, 4, False), (None, 7, 2, False), (7, 7, 2, True)])


def test_null_and_repeated_ids_in_mixing_fingerprints_and_leaks(spark):
    rows = [(None, "a b c d e", "s"), (None, "a b c d e", "s"), (4, "a b c d e", "s"), (4, "q r", "s"), (None, None, None), (None, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_documents(docs).collect()
    assert sum(r["taken"] for r in mix) == math.floor(1.5 * 17) and all(r["taken"] <= 2 * r["size"] for r in mix) and len(mix) == 6
    one = mixing.mix_documents(docs.where("source = 's'")).collect()
    assert {r["target"] for r in one} == {1.5 * 17}
    near = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert near == Counter([(None, 4), (None, 4), (4, 4), (4, 4), (None, None), (None, None)])
    hit = Counter((r["doc_id"], r["n_hit"]) for r in decontaminate.decontaminate_documents(docs, spark.createDataFrame([(1, "q R")], "item_id long, text string")).collect())
    assert hit == Counter([(None, 0)] * 4 + [(4, 0), (4, 2)])


def test_a_file_of_all_notices_has_all_labels(spark):
    notices = [(label, notice) for label, notice, _ in licenses.TEMPLATES]
    every = " . ".join(notice for _, notice in notices)
    for often in ("", "apache", "cc"):
        cases = [(0, every)] + [(i, f"{notice} {i}") for i, (label, notice) in enumerate(notices * 3, 1) if not often or label.startswith(often)]
        got = by_id(licenses.scan_documents(spark.createDataFrame(cases, "doc_id long, text string")))
        assert {label for label, _ in notices} <= set(got[0]["labels"].split(","))


# 7


def hits_by_force(text, items, window=10):
    ws, hit, found = words_of(text), set(), set()
    for item, body in items:
        own = words_of(body)
        for s in range(max(1, len(own) - window + 1) if own else 0):
            w = own[s : s + window]
            for i in range(len(ws) - len(w) + 1):
                if ws[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, rows, nothing, limit):
    source = rows[29][1].split()
    items = [(1, " ".join(source[:25])), (10, " ".join(source[3:14]).upper()), (2, "levy levy"), (3, "a"), (4, None), (5, ""), (6, " ".join(VOCABULARY)), (7, "x y z " * 10), (1, " ".join(rows[2][1].split()[:12]))]
    extra = [(9001, "x y z " * 7, "en", "s", 1, 1, 2, 3.0, 4), (9002, "say levy levy levy a", "en", "s", 1, 1, 2, 3.0, 4), (9002, "say levy levy levy a", "en", "s", 1, 1, 2, 3.0, 4), (9003, " ".join(source[2:15]), "en", "s", 1, 1, 2, 3.0, 4)]
    every = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate_documents(every, bench, broadcast_bytes=limit).collect()
    assert len(got) == len(rows) + 4
    text = {r[0]: r[1] for r in [*rows, *extra]}
    assert all(tuple(r)[1:] == hits_by_force(text[r["doc_id"]], items) for r in got)
    assert decontaminate.decontaminate_documents(nothing, bench).collect() == []
    assert sum(r["n_hit"] for r in decontaminate.decontaminate_documents(docs, bench.limit(0)).collect()) == 0


# 8


def fingerprint_by_force(text):
    ws = words_of(text, r"[^\x20\x09-\x0D]+")
    parts = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("many", [simhash.MANY, 0])
def test_near_duplicates(docs, rows, nothing, monkeypatch, many):
    monkeypatch.setattr(simhash, "CHUNK", 100)
    marks = {r[0]: fingerprint_by_force(r[1]) for r in rows}
    linked = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    roots = components_by_force(marks, linked)
    for i, r in by_id(simhash.near_duplicates(docs, many=many)).items():
        assert (r["fingerprint"], r["component_id"]) == (f"{marks[i]:016x}", roots[i])
    assert simhash.near_duplicates(nothing).collect() == []


def test_no_pair_is_lost(spark):
    rnd = random.Random(4)
    values = {rnd.getrandbits(64) for _ in range(200)}
    for v in list(values)[:100]:
        values.add(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))))
    signed = [v - (v >> 63 << 64) for v in values]
    marks = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for many in (simhash.MANY, 0):
        got = {(r["a"], r["b"]) for r in simhash.near_pairs(marks, many=many).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}


def test_a_cluster_is_joined_without_all_its_pairs(spark):
    rnd = random.Random(6)
    centre, far = rnd.getrandbits(64), rnd.getrandbits(64)
    values = [centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))) for _ in range(300)] + [far, far ^ 3, rnd.getrandbits(64)]
    values = sorted({v - (v >> 63 << 64) for v in values})
    nodes = spark.createDataFrame([(v, (i, v)) for i, v in enumerate(values)], "fingerprint long, first struct<least: long, fingerprint: long>")
    near = [(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    roots = components_by_force(range(len(values)), [(values.index(a), values.index(b)) for a, b in near])
    found = simhash.rooted(nodes).collect()
    assert {r["fingerprint"]: r["root"]["least"] for r in found} == {v: roots[i] for i, v in enumerate(values)}
    left = simhash.near_pairs(simhash.rooted(nodes).selectExpr("fingerprint", "root.fingerprint root")).count()
    assert left == 0 and len(near) > 10_000


def plans_of(monkeypatch, *modules):
    """The plans of all tables that these modules store from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, f=module.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    return plans


def test_no_table_of_fingerprints_or_edges_is_broadcast(spark, docs, rows, monkeypatch):
    """Values in balls are 67 for each fingerprint, of which Spark's estimate counts one."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1, raising=False)
    plans = plans_of(monkeypatch, simhash, components)
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(found.collect()) == len(rows) and sum("SortMergeJoin" in p for p in plans) > 4
    assert not [p for p in plans if "Broadcast" in p]


def test_stars_of_few_edges_are_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    plans = plans_of(monkeypatch, components)
    for limit, found in ((40, True), (39, False)):
        plans.clear()
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        assert {r["root"] for r in components.components(edges).collect()} == {0}
        assert ("BroadcastHashJoin" in plans[2]) == found


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(50)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_by_force(nodes, [e for e in edges if e[0] != e[1]])


# 10


def test_mix(docs, rows, nothing):
    got = by_id(mixing.mix_documents(docs))
    again = by_id(mixing.mix_documents(docs.repartition(6)))
    assert got == again and len(got) == len(rows)
    total = sum(r["size"] for r in got.values())
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        g = got[r[0]]
        assert g["size"] == len(words_of(r[1], r"[^\x20\x09-\x0D]+")) and 0 <= g["taken"] <= 2 * g["size"]
        taken[r[3]] += g["taken"]
        size[r[3]] += g["size"]
        target[r[3]] = g["target"]
    assert sum(taken.values()) == math.floor(1.5 * total) and math.isclose(sum(target.values()), 1.5 * total)
    largest = max(r["size"] for r in got.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest + 1 for s in target) and mixing.mix_documents(nothing).collect() == []
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (3, 1, 2, 3), strict=True))
    left, free, want = 1.5 * total, set(size), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * size[s]}
        want |= {s: 2 * size[s] for s in over} if over else {s: share * weight[s] for s in free}
        left -= sum(2 * size[s] for s in over)
        free = free - over if over else set()
    assert all(math.isclose(want[s], target[s]) for s in size)


def test_ranges_of_any_size_give_the_same_mix(spark, docs):
    slim = docs.select(docs.doc_id.alias("key"), mixing.word_count(docs.text).alias("size"), docs.source)
    show = lambda n: sorted((r["key"], r["taken"]) for r in mixing.fair_mix(common.stored(slim), range_rows=n).collect())
    assert show(200_000) == show(1)


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no tables")
    docs = common.table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, kept, sf))
        before, after = {r["doc_id"] for r in kept.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if name == "quality":
            scores = by_id(quality.score_documents(kept, common.table(spark, sf, "labels")))
            assert after == {i for i, r in scores.items() if r["score"] >= quality.THRESHOLD}
        elif name == "near_duplicates":
            marks = {r["doc_id"]: fingerprint_by_force(r["text"]) for r in kept.collect()}
            roots = components_by_force(marks, [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4])
            assert after == set(roots.values())
        elif name == "decontamination":
            items = [tuple(r) for r in common.table(spark, sf, "benchmark").collect()]
            assert after == {r["doc_id"] for r in kept.collect() if not hits_by_force(r["text"], items)[4]}
        elif name == "mixing":
            words = lambda df: sum(len(words_of(r["text"], r"[^\x20\x09-\x0D]+")) for r in df.collect())
            assert words(out) == math.floor(1.5 * words(kept))
        else:
            assert out.count() == kept.count()
        if name != "sharding":
            assert out.columns == docs.columns
        kept = out


def test_pipeline_keeps_a_row_of_each_component_and_mixes_rows(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    prose = lambda n=40: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 999)) for _ in range(n))
    a, b, c, d, e, f = (prose() for _ in range(6))
    cases = [(1, a), (None, a), (None, b), (None, b), (None, c), (None, d), (2, e), (2, f), (1, f), (5, None), (None, "")] + [(None, prose()) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "en", ["s1", "s2", None][k % 3], len(t or "")) for k, (i, t) in enumerate(cases)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = common.stored(corpus_pipeline.one_of_near_duplicates(spark, docs, ""))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, a), (None, b), (None, c), (None, d), (2, e), (1, f), (5, None)] + [(None, t) for _, t in cases[11:]])
    mix = common.stored(corpus_pipeline.mixed(spark, kept, ""))
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert words(mix) == math.floor(1.5 * words(kept))
    taken = Counter()
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), corpus_pipeline.digest().cast("string")).alias("key")
    for r in mixing.fair_mix(common.stored(kept.select(key, mixing.word_count(kept.text).alias("size"), "source"))).collect():
        taken[r["source"]] += r["taken"]
    assert +taken == Counter({s: n for s in ("s1", "s2", None) if (n := words(mix.where(mix.source.eqNullSafe(s))))})


def test_stages_broadcast_only_counted_tables(spark, monkeypatch):
    """A limit that no table keeps leaves only joins of two shuffles, however small the stages' tables seem to Spark."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"one two three four{i % 7} five six{i % 3}", "en", f"s{i % 3}", 40) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, "two three four5"), (2, "six1")], "item_id long, text string")
    stages = {"near": lambda: corpus_pipeline.one_of_near_duplicates(spark, docs, ""), "mix": lambda: corpus_pipeline.mixed(spark, docs, ""), "leaks": lambda: decontaminate.contaminated(docs, bench, broadcast_bytes=0)}
    expected = {name: Counter(f().collect()) for name, f in stages.items()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1, raising=False)
    plans = plans_of(monkeypatch, corpus_pipeline, simhash, components, mixing, decontaminate)
    for name, f in stages.items():
        plans.clear()
        got = f()
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        assert Counter(got.collect()) == expected[name] and expected[name]
        assert any("SortMergeJoin" in p for p in plans)
        assert not [line for p in plans for line in p.split("\n") if "Broadcast" in line], name


def test_stages_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(13)
    prose = lambda n: " ".join(rnd.choice(VOCABULARY) + str(rnd.randint(0, 999)) for _ in range(n))
    leak, same = prose(14), prose(50)
    texts_ = [None, "", leak, f"see {leak} end", *[same] * 6, *[prose(30) for _ in range(8)]]
    cases = [(None if k % 4 == 0 else k if k < 12 else 5, t, None, ["s1", None][k % 2], None, 7) for k, t in enumerate(texts_)]
    cases += [(9, same, None, "s1", None, 7)] * 5
    docs = spark.createDataFrame(cases, "doc_id long, text string, lang string, source string, n_chars long, shard int")
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    plain = Counter((r[0], r[1]) for r in cases)
    good = by_rows(corpus_pipeline.keep_quality(spark, docs, sf))
    assert not good - plain
    clean = by_rows(corpus_pipeline.without_benchmark(spark, docs, sf))
    assert clean == Counter({k: n for k, n in plain.items() if leak not in (k[1] or "")})
    mix = corpus_pipeline.mixed(spark, docs, sf).collect()
    size = lambda rows: sum(len((t or "").split()) for t in rows)
    assert size(r["text"] for r in mix) == math.floor(1.5 * size(r[1] for r in cases))
    copies = Counter((r["doc_id"], r["source"], r["text"]) for r in mix)
    whole = Counter((r[0], r[3], r[1]) for r in cases)
    cut = [k for k in copies if k not in whole]
    assert len(cut) <= 1 and all(n <= 2 * whole[k] for k, n in copies.items() if k not in cut)
    placed = corpus_pipeline.sharded(spark, docs, sf).collect()
    assert Counter((r["doc_id"], r["text"]) for r in placed) == plain and len({(r["shard"], r["slot"]) for r in placed}) == len(cases)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []


def by_rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())
