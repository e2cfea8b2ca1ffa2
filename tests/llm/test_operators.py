"""Each operator against a brute-force version on small tables with every awkward row: nulls, empty, long, repeated, ties."""

import collections
import hashlib
import itertools
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import attention_lm, chat_format, decontamination, html_extract, license_scan, quality_classifier, quality_rules, queries, simhash, source_mix, suffix_dedup
from vicinity.llm import textblocks as tb

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i * 7919 % 5003}" for i in range(20000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven grey wolves watch from the hill above the river"
TEXTS = [
    "Plain text with some words. " * 3, None, "", " \n\t ", PASSAGE, PASSAGE, PASSAGE.upper() + " and more", "Ünï çödé wörds — ok nbsp em " * 4, LONG, LONG + " tail",
    "x" * 300, "a b", "Released under the MIT License.\nLine\nLine\nother", "GNU General Public License; apache license, Apache License, Version 2.0.", f"intro {PASSAGE} outro",
    "licensed under the new apache license version 2 0", "tab\tseparated\x0bvertical\x0cform", "#*$%&|<> symbols ## here", "one two three four five six seven eight " * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[12], (None, "no id " + PASSAGE, None, "s1", 5)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_word_blocks_equal_regex():
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(TEXTS, pa.string())}).slice(1)
    for size in (1, 64, 1 << 20):
        got = []
        for block in tb.blocks(batch, "text", size):
            words = block.lower().words(tb.NOT_SPACE)
            raw = block.lower().data.tobytes()
            flat = [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)]
            got += [flat[a:b] for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
            assert [int(x) for x in words.hashes()] == [tb.word_hash(w) for w in flat][: len(flat)] if len(flat) < 100 else True
        assert got == [WORD.findall((t or "").translate(LOW)) for t in TEXTS[1:]]


def gst(item, doc, k):
    """Greedy string tiling as published: scan for the longest free match, mark, repeat."""
    k = min(k, len(item))
    a, b, covered = [False] * len(item), [False] * len(doc), 0
    while k:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(doc))):
            m = 0
            while i + m < len(item) and j + m < len(doc) and item[i + m] == doc[j + m] and not a[i + m] and not b[j + m]:
                m += 1
            if m > best[0]:
                best = (m, i, j)
        if best[0] < k:
            return covered
        for x in range(best[0]):
            a[best[1] + x] = b[best[2] + x] = True
        covered += best[0]
    return covered


def test_decontamination_equals_greedy_tiling(spark):
    w = PASSAGE.split()
    items = [(0, PASSAGE), (1, "short one"), (2, None), (3, ""), (4, "a a a a a a a a"), (5, " ".join(w[:12]) + " filler words between halves here")]
    texts = [PASSAGE, " ".join(w[10:] + ["and"] + w[:10]), " ".join(w[:9]), "says Short, ONE!", "a a a a a a a a a a a", "clean text about nothing at all", None, "", " ".join(reversed(w)), "x " * 400 + PASSAGE, " ".join(w[:12]), "a a a a a b a a a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.covered_words) for r in decontamination.leaks(docs, bench).collect())
    want = []
    for (i, t), (j, s) in itertools.product([*enumerate(texts), (0, PASSAGE), (-1, PASSAGE)], items):
        a, b = ALNUM.findall((s or "").translate(LOW)), ALNUM.findall((t or "").translate(LOW))
        c = gst(a, b, 5)
        if a and c >= 0.8 * len(a):
            want.append((i, j, c))
    assert got == sorted(want)
    assert {(1, 0), (3, 1)} <= {x[:2] for x in got}
    assert decontamination.leaks(docs.where("false"), bench).count() == 0 == decontamination.leaks(docs, bench.where("false")).count()


def test_license_scan_equals_brute_force(docs, empty):
    got = license_scan.scan(docs).collect()
    assert len(got) == docs.count()
    by = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    want = collections.Counter()
    for i, t in texts_of(docs):
        w = ALNUM.findall(t.translate(LOW))
        places = [(x, label) for p, label in license_scan.PHRASES for x in range(len(w)) if w[x : x + len(p.split())] == p.split()]
        at = [x for x, _ in places]
        want[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert by == want
    labels = {r.doc_id: (r.labels, r.score, r.spans) for r in got}
    assert labels[13][0] == "apache,gpl" and labels[12][0] == "mit" and labels[4][0] == ""
    assert labels[15][0] == "apache" and len(labels[15][2]) == 2  # an inserted word: neighbouring diagonals merge
    assert all(0 <= s <= 1 for _, s, _ in labels.values())
    assert license_scan.scan(empty).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|body|>x<|end|>", "\\<\\[\\\\", "[", "<\\", "", None, "line\nbreak é ", "$1 \\$2"]
    rows = [(c, t, r, x) for c, x in enumerate(nasty) for t, r in enumerate(("system", "user", "assistant", None, "assistant"))] + [(0, 2, "assistant", "again"), (0, 2, "assistant", "again"), (None, 0, "assistant", "nobody")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat_format.format_chat(turns.select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts")))
    back = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: v[:2])
        assert [(t.role, t.text) for t in back[c].turns] == [v[1:] for v in sorted(mine, key=lambda v: (v[0], v[1], v[2]))]
        assert back[c].loss_text == "".join(t.text for t in back[c].turns if t.role == "assistant")
    for r in out.collect():
        assert r.formatted.count("<|turn|>") == len(r.turn_starts) and "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat_format.format_chat(turns.where("false").select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "a.png", 576), ("audio", None, "b.wav", 30), ("pdf", None, "c.pdf", None), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chat(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <\\this><|image|><|audio|><|document|>end<|end|><|turn|>assistant<|body|><|end|>"
    assert [(a.type, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 576), ("audio", "b.wav", 30), ("pdf", "c.pdf", 0)] and r.expanded_tokens == 606


def fingerprint(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(x, 42) for x in ([b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    return {ids[m]: min((ids[x] for x in g if ids[x] is not None), default=None) for g in groups.values() for m in g}


def test_golay_words_within_two_share_an_index():
    low, high, patterns = simhash.golay()
    assert collections.Counter(len(set(p)) for p in patterns.tolist()) == {6: 1771, 1: 277}
    sets = [set(p) for p in patterns.tolist()]
    flips = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    for d in flips:
        s = int(low[d & 4095] ^ high[d >> 12])
        assert all(any(e ^ d in sets[c ^ s] for e in sets[c]) for c in range(2048))


def test_simhash_equals_brute_force(docs, empty):
    rows = texts_of(docs)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((i is None, i or 0, f"{fingerprint(t):016x}") for i, t in rows)
    want = brute_components([i for i, _ in rows], np.array([fingerprint(t) for _, t in rows], np.uint64))
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("group", [8192, 8])
def test_simhash_links_whatever_the_group_size(spark, group):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base[:10]:  # chains and clusters of near fingerprints
        x = b
        for _ in range(12):
            x = x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64))
            fps.append(x)
    fps += [base[0] ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rng.integers(0, 64, (60, 2)) if i != j]
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    from vicinity.operators.clustering import components

    found = {r.node: r.root for r in components(simhash.links(df, len(fps), group=group, keys_a_task=2000)).collect()}
    ids = fps.view(np.int64).tolist()
    want = brute_components(ids, fps)
    assert {i: found.get(i, i) for i in ids} == want


def test_attention_lm_base_and_model(spark, docs):
    ranks = Path("/opt/tokenizers/byte_bpe_50k.tiktoken").read_bytes()
    got = attention_lm.score(docs, ranks, queries.WORD_PATTERN, block_bytes=3000, bucket_words=500, least_ids=1000, task_ids=5000).collect()
    tokens = [(i, t.encode().lower().split() + [None]) for i, t in texts_of(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert attention_lm.score(docs.where("false"), ranks, queries.WORD_PATTERN).count() == 0


RANKS = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")


def trained(ids, at, steps=3):
    vocabulary = attention_lm.Vocabulary(np.bincount(ids, minlength=400).astype(float))
    trainer = attention_lm.Trainer(attention_lm.start(vocabulary))
    for seed in range(steps):
        trainer.learn(vocabulary, ids, at, seed)
    return vocabulary, trainer


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no tables")
def test_attention_lm_beats_the_base_on_held_out_documents(spark):
    """The registered query, over all held-out documents."""
    got = [r for r in queries.op5_attention_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 50 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_attention_lm_trains_on_every_document(spark, monkeypatch):
    """Every document that isn't held out is in a turn, whole, and training takes each window of a block once."""
    docs = spark.createDataFrame([(i, f"word{i} and some more " * (i % 4)) for i in range(300)] + [(None, None)], "doc_id long, text string").repartition(5)
    shared = spark.sparkContext.broadcast((RANKS.read_bytes(), queries.WORD_PATTERN))
    words = attention_lm.Subwords(*shared.value)
    rows = attention_lm.encode(docs, shared, 500).collect()
    assert {r.turn for r in rows} == set(range(len(attention_lm.TURNS))) and len({r.block for r in rows}) == len(rows) > 20
    found = []
    for r in rows:
        ids, at = attention_lm._training(r)
        found += [tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(at)]
    want = [tuple(words([t.encode()])[0][0:0]) if not t else tuple(words([w.encode() for w in t.split()])[0].tolist()) for i, t in ((r.doc_id, r.text or "") for r in docs.collect()) if i is None or zlib.crc32(str(i).encode()) % 10]
    assert sorted(found) == sorted((*w, words.end) for w in want)

    seen = []
    monkeypatch.setattr(attention_lm.Trainer, "step", lambda self, w, chosen: seen.extend(w.places(chosen)[0][w.places(chosen)[1]].tolist()))
    trained(np.arange(400).repeat(50), np.array([0, 5, 5, 9000, 20000]), 1)
    assert sorted(seen) == list(range(20000))


def test_attention_gradients():
    rng = np.random.default_rng(1)
    ids, at = rng.integers(0, 400, 130), np.array([0, 7, 7, 130])
    for context in (0, attention_lm.CONTEXT):
        vocabulary, trainer = trained(ids, at)
        p = trainer.p
        w = attention_lm.Windows(vocabulary.classes[ids], at, context)
        place, ok = w.places(slice(None))
        target = ok[:, context:].ravel()
        assert sorted(place[:, context:].ravel()[target].tolist()) == list(range(130))  # each once

        def loss(q, w=w, place=place, ok=ok, target=target, context=context):
            h, _ = attention_lm.forward(q, w.one[place], w.two[place], ok, context)
            return -attention_lm.class_log_probabilities(q, h[target], w.classes[place[:, context:]].ravel()[target], False)[0].astype(float).mean()

        dense, tables = attention_lm.gradients(p, w, slice(None))
        for k, (rows, g, _) in tables.items():
            dense[k] = np.zeros_like(p[k])
            dense[k][rows] = g
        assert dense.keys() == p.keys()
        for k, g in dense.items():
            size = np.linalg.norm(g)
            step = 1e-2 * g / size
            slope = (loss(p | {k: p[k] + step}) - loss(p | {k: p[k] - step})) / 2e-2
            assert slope == pytest.approx(size, rel=3e-2, abs=2e-4), (k, context)


def test_attention_rows_left_out_and_sums_by_row():
    """Places behind a text's end are weighed instead of cut out, and rows of the tables are summed without a call for each."""
    rng = np.random.default_rng(4)
    vocabulary, trainer = trained(rng.integers(0, 400, 130), np.array([0, 7, 130]))
    h, y, target = rng.normal(size=(5000, attention_lm.WIDTH)).astype(np.float32), vocabulary.classes[rng.integers(0, 400, 5000)], rng.random(5000) < 0.9
    logs, dh, dense = attention_lm.class_log_probabilities(trainer.p, h, y, True, target)
    want_logs, want_dh, want = attention_lm.class_log_probabilities(trainer.p, h[target], y[target], True)
    assert np.allclose(logs[target], want_logs, atol=1e-5) and np.allclose(dh[target], want_dh, atol=1e-7) and not dh[~target].any()
    assert dense.keys() == want.keys() and all(np.allclose(dense[k], want[k], atol=1e-6) for k in want)
    for rows in (rng.integers(0, 3000, 5000), rng.integers(0, 50, 5000), np.minimum(rng.zipf(1.5, 5000), 3000)):
        for chosen in (None, np.flatnonzero(target)):
            some = slice(None) if chosen is None else chosen
            total = np.zeros((3001, attention_lm.WIDTH))
            np.add.at(total, rows[some], h[some])
            found, sums, counts = attention_lm._row_sums(rows.astype(np.int16), h, chosen)
            assert np.array_equal(found, np.unique(rows[some])) and np.array_equal(counts, np.bincount(rows[some])[found]) and np.allclose(sums, total[found], atol=1e-3)


def test_attention_lm_scores_and_splits_do_not_depend_on_what_came_before(monkeypatch):
    """Windows that share their context across batches or texts, and words that the process has met in other blocks."""
    rng = np.random.default_rng(5)
    ids, at = rng.integers(0, 400, 400), np.array([0, 1, 25, 200, 224, 400])
    vocabulary, trainer = trained(ids, at)
    want = np.concatenate([attention_lm.log_probabilities(trainer.p, vocabulary, ids[a:b], np.array([0, b - a])) for a, b in itertools.pairwise(at)])
    for batch in (1, 2, 3, 256):
        assert np.allclose(attention_lm.log_probabilities(trainer.p, vocabulary, ids, at, batch), want, atol=1e-5)

    fresh = lambda: attention_lm.Subwords(RANKS.read_bytes(), queries.WORD_PATTERN)
    texts = [" ".join(f"w\u00f6rd{i * k % 17} Some{i}thing" for i in range(40)) for k in range(1, 7)] + ["", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") * 3]
    for most in (1 << 20, 50):
        monkeypatch.setattr(attention_lm, "KNOWN_WORDS", most)
        kept = fresh()
        for t in texts * 2:
            block = next(tb.blocks(pyarrow.record_batch({"text": pyarrow.array([t, "some more"])}), "text"))
            got, new = attention_lm.Tokens(block, kept), attention_lm.Tokens(block, fresh())
            assert got.ids.tolist() == new.ids.tolist() and got.ids_at.tolist() == new.ids_at.tolist()
        assert len(kept.known) <= most + 80


def test_attention_lm_equals_a_plain_loop():
    """Log probabilities of the registered settings against one place at a time; nothing later matters, and all ids' sum to 1."""
    rng = np.random.default_rng(2)
    ids, at = rng.integers(0, 400, 150), np.array([0, 1, 60, 150])
    vocabulary, trainer = trained(ids, at)
    p = {k: v.astype(float) for k, v in trainer.p.items()}
    scored = attention_lm.WINDOW - attention_lm.CONTEXT

    def embedding(text, i):
        last, before = (int(vocabulary.classes[text[i - n]]) if i >= n else attention_lm.CLASSES for n in (1, 2))
        pair = tb.mix(np.array([before * (attention_lm.CLASSES + 1) + last + 7], np.uint64))[0] % np.uint64(attention_lm.PAIR_ROWS)
        return p["one"][last] + p["two"][int(pair)]

    def plain(text, i, y):
        seen = list(range(max(0, i // scored * scored - attention_lm.CONTEXT), i + 1))
        e = [embedding(text, j) for j in seen]
        weight = np.exp([(e[-1] @ p["wq"]) @ (x @ p["wk"]) * attention_lm.KEY_WIDTH**-0.5 + p["rel"][i - j] for j, x in zip(seen, e, strict=True)])
        h = e[-1] + (sum(a * (x @ p["wv"]) for a, x in zip(weight, e, strict=True)) / weight.sum()) @ p["wo"]
        group, member = divmod(int(vocabulary.classes[y]), attention_lm.MEMBERS)
        out = 0.0
        for z, c in ((h @ p["group"] + p["group_b"], group), (h @ p["member"][group] + p["member_b"][group], member)):
            out += z[c] - np.log(np.exp(z).sum())
        return out + vocabulary.log_share[y]

    got = attention_lm.log_probabilities(trainer.p, vocabulary, ids, at)
    want = [plain(ids[a:b], i, ids[a + i]) for a, b in itertools.pairwise(at) for i in range(b - a)]
    assert np.allclose(got, want, atol=2e-4)
    other = ids.copy()
    other[100:] = 5
    assert np.allclose(attention_lm.log_probabilities(trainer.p, vocabulary, other, at)[:100], got[:100], atol=1e-5)
    for i in (0, 9, 40):
        assert np.logaddexp.reduce([plain(ids[60:], i, y) for y in range(400)]) == pytest.approx(0, abs=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><p>Site of the many words and of the other things that it has</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>
<div class="cookie-notice">We use cookies and other things that you have to accept for this and that, as it is the law of the land.</div>
<article><h1>Title &amp; more</h1><p>First   &lt;para&gt;<b>graph</b> is the one that has all of the words in it and it is long enough to be good.<p>Short.<br>Line
<div class="ad">Buy the best of all the things that there are in the world, as they are on sale for you!</div>
<ul><li>Point one<li>Point two</ul><aside>related of the things</aside><form><input><p>Subscribe to the list of all the things</p></form>
<p>Last one is also the kind of text that there is in a page, and it ends with an open tag.</article>
<section id="comments"><article class="comment"><p>I think that this is the best page of all that I have seen in my life, thanks for it.</p></article></section>
<footer>&copy; of the site</footer></body></html>"""


def test_html_extraction(spark):
    want = "Title & more\n\nFirst <para>graph is the one that has all of the words in it and it is long enough to be good.\n\nShort. Line\n\nPoint one\n\nPoint two\n\nLast one is also the kind of text that there is in a page, and it ends with an open tag."
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract("<p>" + "The page has no article but it is the text of the page and it has all of the words. " * 3 + "<p>Ok.") .endswith("Ok.")
    assert html_extract.extract("<div><a href=x>only links of the site</a> <a href=y>and more of them in the page of the site</a></div>") == ""
    for odd in (None, "", "<", "<p", "<article><p>text<scr", "<!-- open", "<script>open", "a < b", "<article>" * 3000 + "deep"):
        html_extract.extract(odd)
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article>" + "word " * 50000 + "</article>")], "page_id long, url string, html string")
    got = html_extract.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == sorted([(1, len(want), len(want))] * 2 + [(2, 0, 0), (0, 249999, 249999)])
    assert html_extract.main_text(pages.where("false")).count() == 0


def plain_blocks(page):
    """Blocks of a well-formed page by the standard parser: (text, linked, inside, place, heading, container)."""
    from html.parser import HTMLParser

    out, stack, parts, ids = [], [], [], itertools.count(1)

    class Parser(HTMLParser):
        linked, skip = 0, None

        def flush(self):
            text = " ".join("".join(parts).split())
            if text:
                tags = [t for t, _, _ in stack]
                box = [i for t, _, i in stack if t in html_extract.CONTAINERS]
                place = 2 if {"nav", "footer", "head"} & set(tags) or any(c == "ad" for _, c, _ in stack) else 0
                out.append(html_extract.Block(text, self.linked, "article" in tags, place, "h1" in tags, box[-1] if box else 0))
            parts.clear()
            self.linked = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("title", "style", "script"):
                self.skip = tag
            elif tag == "br":
                parts.append(" ")
            elif tag != "meta":
                if tag in html_extract.BLOCK_TAGS:
                    self.flush()
                    while tag == "p" and any(t == "p" for t, _, _ in stack):
                        stack.pop()
                stack.append((tag, dict(attrs).get("class"), next(ids)))

        def handle_endtag(self, tag):
            if tag == self.skip:
                self.skip = None
                return
            if tag in html_extract.BLOCK_TAGS:
                self.flush()
            if any(t == tag for t, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not self.skip:
                parts.append(data)
                self.linked += len(data) if any(t == "a" for t, _, _ in stack) else 0

    parser = Parser()
    parser.feed(page)
    parser.flush()
    return out


def plain_classify(found):
    """Both passes by their definition, a block at a time, looking at all others."""
    marked = any(b.inside for b in found)
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    stops = lambda t: sum(w in html_extract.STOP_WORDS for w in words(t))
    some_stops = any(stops(b.text) for b in found)

    def judge(group):
        text, n = " ".join(b.text for b in group), sum(len(b.text) for b in group)
        if group[0].place == 2 or sum(b.linked for b in group) > n / 2:
            return False
        if n < 70 or all(b.heading for b in group):
            return None
        density = stops(text) / max(len(words(text)), 1) if some_stops else 0.2 if n >= 140 else 0.05
        if density >= (0.05 if group[0].inside else 0.35 if marked else 0.2):
            return True
        if group[0].inside:
            return None
        return False if marked or (n >= 140 and density < 0.05) else None

    first = [judge([b]) for b in found]

    def nearest(i, among, labels):
        known = [j for j in among if labels[j] is not None]
        least = min((abs(among.index(j) - among.index(i)) for j in known), default=None)
        return None if least is None else any(labels[j] for j in known if abs(among.index(j) - among.index(i)) == least)

    second = list(first)
    for i, b in enumerate(found):
        if first[i] is None:
            group = [j for j, c in enumerate(found) if c.place < 2 and (c.container, c.inside) == (b.container, b.inside)]
            second[i] = nearest(i, group, first) if any(first[j] is not None for j in group) else judge([found[j] for j in group])
    page = [j for j, c in enumerate(found) if c.place < 2]
    third = [nearest(i, page, second) if x is None else x for i, x in enumerate(second)]
    return [b.inside if x is None else x for b, x in zip(found, third, strict=True)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no tables")
def test_html_passes_decide(spark, monkeypatch):
    """On all pages, and on the same without a marked article: equal to brute force, and the density rules matter."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"(</?)article\b", r"\1div", x) for x in pages]
    for page in [*pages, *bare]:
        found = plain_blocks(page)
        got, marked = html_extract.blocks(page)
        assert [(b.text, b.linked > 0, b.inside, b.place, b.heading) for b in got] == [(b.text, b.linked > 0, b.inside, b.place, b.heading) for b in found]
        assert html_extract.classify(got, marked) == plain_classify(found)
    split = lambda x: set(html_extract.extract(x).split("\n\n"))
    want, have = [split(x) for x in pages], [split(x) for x in bare]
    both = sum(len(a & b) for a, b in zip(want, have, strict=True))
    assert both >= 0.98 * sum(map(len, want)) and both >= 0.98 * sum(map(len, have))
    monkeypatch.setattr(html_extract, "STOP_GOOD", 2.0)
    monkeypatch.setattr(html_extract, "STOP_BAD", 1.5)
    assert sum(split(x) != y for x, y in zip(bare, have, strict=True)) > len(bare) / 2


def test_html_hints_and_long_open_pages():
    dense = "This is the text of the page and it has all of the words that are in it. " * 3
    assert html_extract.extract(f"<article><p>{dense}<div class=related>{dense}</div></article>").count("This is") == 6
    assert html_extract.extract(f"<article><p>{dense}</article><div class=related>{dense}</div>").count("This is") == 3
    other = "Tämä sivu kertoo kaikesta mikä liittyy vanhaan kaupunkiin sekä ihmisiin jotka asuivat siellä kauan sitten " * 2
    assert html_extract.extract(f"<div><p>{other}</p><p>Lyhyt.</p></div>") == f"{other.strip()}\n\nLyhyt."
    import time

    def seconds(n):
        began = time.perf_counter()
        html_extract.extract("<b>" * n + "<p>" * n + "<div>" * n + '<a "' * n + "</i>" * n)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40000) < 16 * seconds(10000) + 1  # 0.7 MB of unclosed tags


def test_classifier_learns_and_takes_every_row(spark, docs, empty):
    rng = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = [vocab[k] for k in rng.integers(0, 200, rng.integers(5, 60))]
        good = i % 2
        rows.append((i, " ".join(w) if good else " ".join(x + rng.choice(["###", "$$$", "|"]) for x in w), "en", "s", None, good))
    df = spark.createDataFrame(rows, DOCS + ", label int")
    model = quality_classifier.train(df.drop("label"), df.where("doc_id % 3 <> 1").select("doc_id", "label"), max_rows=256)
    got = {r.doc_id: r.predicted for r in quality_classifier.score(df, model).collect()}
    assert np.mean([got[i] == i % 2 for i in range(600) if i % 3 == 1]) > 0.97
    scored = quality_classifier.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in scored)
    blank = quality_classifier.train(empty, df.select("doc_id", "label"))
    assert {r.score for r in quality_classifier.score(docs, blank).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    model = quality_classifier.Model(0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    x = rng.normal(size=12)
    got, _ = quality_classifier.raw_scores(model, np.zeros(12, np.int64), np.arange(12), x, 1)
    want = 0.3 + model.w @ x + sum(model.v[i] @ model.v[j] * x[i] * x[j] for i in range(12) for j in range(i))
    assert got[0] == pytest.approx(want)


def brute_removed(rows):
    least = {}
    for i, t in rows:
        b = t.encode()
        for x in range(len(b) - 49):
            k = b[x : x + 50]
            least[k] = min(least.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for x in range(len(b) - 49):
            if least[b[x : x + 50]] < (math.inf if i is None else i):
                gone[x : x + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [200, 3 << 20])
def test_suffix_dedup_equals_brute_force(spark, docs, empty, block_bytes):
    extra = [(100 + i, t) for i, t in enumerate(["aaaa" * 40, "aaaa" * 30 + "b", "é" * 60, "x" + "é" * 40, PASSAGE[:50], PASSAGE[:49], PASSAGE[10:70] + PASSAGE[:60]])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_spans(df, block_bytes=block_bytes).collect())
    assert got == brute_removed(texts_of(df))
    assert suffix_dedup.removed_spans(empty).count() == 0


def test_suffix_dedup_survives_equal_hashes():
    """With one hash for all segments, a block finds the same bytes as with the real ones."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    shared = ["".join(rng.choice(list("abcdef "), 90)) for _ in range(4)]
    texts = ["".join(rng.choice(list("abcdef "), 40)) + shared[i % 4] + shared[(i * 3 + 1) % 4] for i in range(20)]
    packed = pa.Table.from_batches(suffix_dedup.db.pack_documents([pa.record_batch({"doc_id": pa.array(range(20), pa.int64()), "text": texts})], 1))
    found = []
    for same in (False, True):
        part = suffix_dedup._Part(packed, suffix_dedup.LENGTH)
        if same:
            part.content[:] = 7
        seeds = suffix_dedup._answer_seeds(suffix_dedup._send_seeds(0, part, 4))
        segments = suffix_dedup._send_segments(0, part, seeds, 4)
        each = [segments.filter(pa.compute.equal(segments["bucket"], b)) for b in set(segments["bucket"].to_pylist())]
        answers = pa.concat_tables([seeds, *(suffix_dedup._answer_segments(t, suffix_dedup.LENGTH) for t in each)])
        found.append((len(part.shared(seeds, 4)[1]), suffix_dedup._removed(part, answers, 4)))
    assert found[1][0] > found[0][0] and found[0][1].sum() > 1000 and (found[0][1] == found[1][1]).all()


def test_suffix_dedup_carries_columns(docs):
    out = suffix_dedup.kept_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    row = {r.doc_id: r for r in out.collect()}
    assert row[14].text.strip() in ("intro  outro", "introutro", "intr", "intro outro") or len(row[14].text) < 20
    assert row[7].text == TEXTS[7] and row[7].source is None and row[8].n_chars == len(LONG)


def test_source_mix_reaches_its_targets(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), "en", s, 0) for i in range(900) for s in [("a", "b", "c", "d", None)[int(rng.integers(5)) if i % 3 else 0]]]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], DOCS)
    options = {"block_words": 64, "docs_a_chunk": 50, "slots_a_chunk": 37}
    first = source_mix.mix_by_document(df, **options).collect()
    again = source_mix.mix_by_document(df.repartition(7), **options).collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 902
    by = collections.defaultdict(list)
    for r in first:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    left, budget, target = dict(weights), 1.5 * sum(sizes.values()), {}
    while True:
        over = [s for s in left if budget * left[s] / sum(left.values()) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left.pop(s)
        budget = 1.5 * sum(sizes.values()) - sum(target.values())
    target |= {s: budget * w / sum(left.values()) for s, w in left.items()}
    for s, v in by.items():
        assert v[0].target == pytest.approx(target[s]) and v[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in v) - target[s]) <= 1 and all(0 <= r.taken <= 2 * r["size"] for r in v)
    assert source_mix.mix_by_document(docs).count() == docs.count()
    assert source_mix.mix_by_document(empty).count() == 0


def test_schedule_is_spread(spark):
    src = spark.createDataFrame([(1, 500), (2, 300), (3, 200), (4, 1), (5, 0)], "sid long, need long")
    rows = source_mix.schedule(src, 1001, slots_a_chunk=100).orderBy("slot").collect()
    assert collections.Counter(r.sid for r in rows) == {1: 500, 2: 300, 3: 200, 4: 1}
    for sid in (1, 2, 3, 4):
        assert sorted(r.block for r in rows if r.sid == sid) == list(range({1: 500, 2: 300, 3: 200, 4: 1}[sid]))
    for n in (50, 250, 700):  # any prefix is near the shares
        part = collections.Counter(r.sid for r in rows if r.slot < n)
        assert abs(part[1] - n / 2) < 5 and abs(part[2] - 0.3 * n) < 5


def test_source_mix_returns_the_schedule(spark):
    """Each row's first, last and number of slots are those of its pieces in the mix, and sources take turns."""
    docs = spark.createDataFrame([(i, "w " * (40 + i % 90), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    rows = source_mix.sized(docs)
    sources = source_mix.targets(rows, block_words=64)
    slots = collections.defaultdict(set)
    for r in source_mix.mix(rows, sources, block_words=64).collect():
        slots[r.doc_id].add(r.slot)
    got = source_mix.mix_by_document(docs, block_words=64).collect()
    assert {r.doc_id: (r.first_slot, r.last_slot, r.n_slots) for r in got} == {i: (min(slots[i]), max(slots[i]), len(slots[i])) if slots[i] else (None, None, 0) for i in range(400)}
    assert len({r.source_size for r in got}) == 3
    whole = max(r.last_slot for r in got if r.n_slots) + 1
    for size in {r.source_size for r in got}:  # no source waits for another's end
        assert min(r.first_slot for r in got if r.source_size == size and r.n_slots) < 10 and max(r.last_slot for r in got if r.source_size == size and r.n_slots) > whole - 20


def test_quality_rules_equal_brute_force(spark, docs, empty):
    trusted = spark.createDataFrame([(0,), (4,), (4,), (None,), (999,)], "doc_id long")
    got = quality_rules.quality_rules(docs, trusted, buckets=512).collect()
    grams = lambda t: (lambda w: [tb.word_hash(x) for x in w] + [pair(a, b) for a, b in itertools.pairwise(w)])(WORD.findall(t.translate(LOW)))

    def pair(a, b):
        raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        w = tb.Block(raw, np.array([0, len(raw)]), 0).words(tb.NOT_SPACE)
        return int(w.grams(w.hashes(), 2)[0][0])

    rows = texts_of(docs)
    raw, good = np.zeros(512), np.zeros(512)
    for i, t in rows:
        for g in grams(t):
            raw[g % 512] += 1
            good[g % 512] += i in (0, 4)
    s, k = quality_rules.SMOOTHING, 512
    p = (raw + s) / (raw.sum() + s * k)
    ratio = np.log((good + s * k * p) / (good.sum() + s * k)) - np.log(p)
    want = []
    for i, t in rows:
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[x : x + 8]) for x in range(len(w) - 7))
        covered = {y for x in range(len(w) - 7) if windows[tuple(w[x : x + 8])] > 1 for y in range(x, x + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = grams(t)
        score = sum(ratio[x % 512] for x in g) / max(len(g), 1)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        want.append((i is None, i or 0, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), round(score, 6) + 0.0, failed, not failed and round(score, 9) >= quality_rules.THRESHOLD))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, round(r.score, 6) + 0.0, r.base_failed, r.kept) for r in got) == sorted(want)
    assert quality_rules.quality_rules(empty, trusted).count() == 0
    assert {r.score for r in quality_rules.quality_rules(docs, trusted.where("false")).collect()} == {0.0}


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").is_dir(), reason="no tables")
def test_quality_verdicts_do_not_depend_on_the_table_size(spark):
    """A tenth of the documents and all of them get the same verdicts; half of the good ones aren't trusted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id is not null")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    trusted = labels.where("quality = 1 and crc32(cast(cast(doc_id as string) as binary)) % 2 = 1").select("doc_id")
    quality = {r.doc_id: r.quality for r in labels.collect()}

    def kept(docs):
        found = quality_rules.quality_rules(docs, trusted, rare=quality_rules.RARE).where("not base_failed")
        return {r.doc_id: r.kept for r in found.select("doc_id", "kept").collect()}

    tenth, whole = kept(docs.where("doc_id % 10 = 0")), kept(docs)
    both = [i for i in tenth if i in whole]
    assert len(both) > 500 and sum(tenth[i] != whole[i] for i in both) <= 0.02 * len(both)
    for want in (0, 1):
        some = [whole[i] for i in whole if quality.get(i) == want]
        assert sum(x != bool(want) for x in some) <= 0.02 * len(some)


def test_tiles_of_repeated_words_need_little_memory():
    import tracemalloc

    item, doc = np.zeros(200, np.uint64), np.zeros(32000, np.uint64)
    tracemalloc.start()
    assert decontamination.tiles(item, doc) == [(200, 0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def test_extra_columns_with_clashing_names(spark, docs):
    wide = docs.withColumns({c: F.lit("clash") for c in ("fp", "size", "key", "uid", "row", "seed", "words", "trusted", "block", "score", "label", "i", "carried")})
    assert simhash.near_duplicates(wide).count() == license_scan.scan(wide).count() == source_mix.mix_by_document(wide).count() == suffix_dedup.removed_spans(wide).count() == docs.count()
    assert quality_rules.quality_rules(wide, docs.select("doc_id").limit(1)).count() == docs.count()
    assert suffix_dedup.kept_texts(wide).columns == wide.columns
    items = spark.createDataFrame([(1, PASSAGE, "x", 2)], "item_id long, text string, words string, uid long")
    assert sorted(str(r) for r in decontamination.leaks(wide.withColumn("item", F.lit("x")), items).collect()) == sorted(str(r) for r in decontamination.leaks(docs, items.select("item_id", "text")).collect())
    model = quality_classifier.train(wide.withColumn("value", F.lit("x")), docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as label").where("doc_id is not null"))
    kept = quality_classifier.keep_good(wide, model)
    assert kept.columns == wide.columns and quality_classifier.score(wide, model).count() == docs.count()
    assert kept.count() == quality_classifier.score(docs, model).where("predicted = 1").count()
    assert attention_lm.score(wide.withColumn("ids", F.lit("x")), RANKS.read_bytes(), queries.WORD_PATTERN, least_ids=1).count() == docs.count()
    pages = spark.createDataFrame([(1, "u", "<p>x", "clash")], "page_id long, url string, html string, text string")
    assert html_extract.main_text(pages).columns == ["page_id", "url", "text", "n_chars"]
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], "conv_id long, turn long, role string, text string, content string, formatted string")
    turns = turns.withColumn("parts", chat_format.text_parts(F.col("text")))
    assert chat_format.read_back(chat_format.format_chat(turns)).count() == 1
