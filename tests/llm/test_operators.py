"""Each operator's query on odd and on empty tables, and each against a brute-force version."""

import base64
import collections
import gzip
import hashlib
import math
import zlib
from importlib.metadata import distribution

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, catalog, common, hashing, language, licenses, lm, neardup, packing, ranges, repetition, toxicity, warc, winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables_give_no_rows(spark, folder, name):
    assert catalog.queries()[name](spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(catalog.queries()) if n not in ("op2_license_scans", "op9_best_fit_packing", "op10_warc", "op12_spelling_variants")])
def test_odd_rows_have_a_row_each(spark, folder, odd, name):
    got = catalog.queries()[name](spark, f"{folder}/odd")
    rows = got.collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    for a, b in zip(*[[tuple(x) for x in rows if x["doc_id"] == 6]] * 2, strict=True):
        assert a == b


def test_fingerprints_of_edits(spark, docs, texts):
    got = {r["doc_id"]: r for r in winnow.op1_fingerprints(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[here], texts[after]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert got[here].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[here].n_chars == len(t) and 0 <= got[here].near_edited <= 1 and 0 <= got[here].near_next <= 1
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    long = [i for i, t in texts.items() if len(t) > 1000 and len(set(t.split())) > 100]
    assert all(got[i].near_edited > got[i].near_next or texts[i] == texts[order[(order.index(i) + 1) % len(order)]] for i in long)


def _winnowed(values, window):
    """Positions by the book: the least of each window, the rightmost of equal ones."""
    out = set()
    for i in range(max(1, len(values) - window + 1)):
        part = values[i : i + window]
        least = min(part)
        out.add(i + max(k for k, v in enumerate(part) if v == least))
    return out


def test_windows_choose_the_rightmost_least(spark):
    words = [f"w{i % 7}{'x' * (i % 3)}" for i in range(60)]
    one = spark.createDataFrame([(" ".join(words),)], "text string")
    row = one.select(F.transform(winnow.word_pieces(F.col("text")), lambda w: F.xxhash64(w)).alias("h"), winnow.fingerprint(F.col("text")).alias("m"), winnow.positions(winnow.fingerprint(F.col("text"))).alias("p")).first()
    rot = lambda x, n: ((x << n) | (x >> (64 - n))) & (2**64 - 1) if n else x
    h = [x % 2**64 for x in row.h]
    grams = [(rot(h[i], 2) ^ rot(h[i + 1], 1) ^ h[i + 2]) >> 28 for i in range(len(h) - 2)]
    assert set(row.p) == _winnowed(grams, winnow.WINDOW)
    assert {m >> 27 for m in row.m} == {grams[p] for p in row.p}


def test_shared_passages_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    two = spark.createDataFrame([(1, "a b c d e " + passage + " f g"), (2, "q r s " + passage + " t u v")], "doc_id int, text string")
    hits = winnow.shared_passages(two)
    assert hits.alias("x").join(hits.alias("y"), (F.col("x.hash") == F.col("y.hash")) & (F.col("x.doc_id") < F.col("y.doc_id"))).count() >= 1


def test_equal_ids_and_nulls_follow_each_other(spark):
    rows = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (2, "b")], "doc_id bigint, text string")
    got = {r.text: r.next_text for r in winnow.with_next(rows, range_rows=1).collect()}
    assert got == {"c": "b", "b": "a", "a": "n", "n": "c"}


def test_cut_points_are_exact(spark):
    values = [5] * 100 + list(range(1000, 1100)) + [10**15]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("w", F.lit(1))
    cuts = ranges.cut_points(df, "v", "w", 30)
    sizes = collections.Counter(sum(c <= v for c in cuts) for v in values)
    assert max(n for k, n in sizes.items() if k != 0) <= 30 and sizes[0] == 100
    got = {r.v: r.p for r in df.select("v", ranges.place(F.col("v"), cuts).alias("p")).collect()}
    assert all(got[v] == sum(c <= v for c in cuts) for v in values)


def test_licenses_by_brute_force(spark, docs, texts):
    got = {(r.doc_id, r.unit, r.place): (r.license, round(r.dice, 6)) for r in licenses.scan(docs).collect()}
    known = {k: licenses.bigrams(t) for k, t in licenses.TEMPLATES.items()}
    want = {}
    for i, t in texts.items():
        lines = t.split("\n")
        for unit, parts in (("line", lines), ("text", [t] if len(lines) > 1 else [])):
            for place, s in enumerate(parts, 1):
                own = licenses.bigrams(s)
                best = max(((2 * len(own & g) / (len(own) + len(g)), k) for k, g in known.items()), default=(0, ""))
                if own and best[0] >= licenses.LEAST:
                    want[i, unit, place] = (best[1], round(best[0], 6))
    assert {k: v for k, v in got.items() if k[1] in ("line", "text")} == want and want


def test_license_texts_match_themselves(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(licenses.TEMPLATES.values())], "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).filter("unit = 'line'").collect()}
    assert [got[i].license for i in range(len(licenses.TEMPLATES))] == list(licenses.TEMPLATES) and all(r.dice == 1 for r in got.values())


BSD_3 = """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
"""


def test_published_licenses_are_found(spark):
    published = [distribution("packaging").locate_file(f) for f in distribution("packaging").files if f.name in ("LICENSE.APACHE", "LICENSE.BSD")]
    apache, bsd_2 = (p.read_text() for p in sorted(published))
    rows = spark.createDataFrame(list(enumerate([apache, bsd_2, BSD_3, UNLICENSE])), "doc_id int, text string")
    got = {r.doc_id: r.license for r in licenses.scan(rows).filter("unit = 'text'").collect()}
    assert got == {0: "Apache-2.0 (text)", 1: "BSD-2-Clause (text)", 2: "BSD-3-Clause (text)", 3: "Unlicense (text)"}
    assert {k.split(" (")[0] for k in licenses.TEMPLATES if k.endswith("(text)")} == {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense"}


def test_licenses_inside_longer_texts(spark):
    prose = " ".join(f"prose{i} about" for i in range(60))
    mit = licenses.TEMPLATES["MIT"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    parts = "\n\n".join(" ".join(mit[i : i + 60]) for i in range(0, len(mit), 60))
    changed = " ".join("thing" if i % 12 == 5 else w for i, w in enumerate(mit))
    texts = [f"{prose}\n\n{parts}\n\n{prose}", f"{prose}\n{wrapped}\n{prose}", f"{prose} {changed} {prose}", "Copyright (c) 2021 Acme Inc. Released under the MIT License.", prose, f"{prose}\n\n{BSD_3}\n\n{prose}", f"{prose} {' '.join(mit)} {prose} {' '.join(mit)}"]
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).filter("unit = 'window'").collect():
        got[r.doc_id].append((r.license, r.place))
    n = len(licenses.normal_words(prose))
    assert got[0] == got[1] == got[2] == [("MIT", n + 1)] and got[3] == [("MIT (line)", 6)] and 4 not in got
    assert any(x[0].startswith("BSD-3-Clause") for x in got[5]) and sorted(got[6]) == [("MIT", n + 1), ("MIT", 2 * n + len(licenses.normal_words(" ".join(mit))) + 1)]


def test_texts_without_an_anchor_word_hold_no_match():
    words = set(licenses.anchor_words(licenses.TEMPLATES))
    for k, t in licenses.TEMPLATES.items():
        own = licenses.bigrams(t)
        bare = {g for g in own if not words & set(g)}
        assert 2 * len(bare) < licenses.LEAST * (len(bare) + len(own)), k


def test_base_scores_and_model(spark, docs, texts):
    got = {r.doc_id: r for r in lm.op3_lm_scoring(spark, SF).collect()}
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*t.encode().lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*t.encode().lower().split(), b""]
        assert got[i].n_tokens == len(words) and got[i].n_known == sum(counts[w] > 0 for w in words) and got[i].train_tokens == total
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_size_of_the_model():
    net = lm.LogBilinear.fresh(np.full(lm.CLASSES, 1 / lm.CLASSES))
    assert net.R.shape == net.Q.shape == (lm.CLASSES, lm.DIMENSIONS) == (128, 24) and net.C.shape == (4, 24)


def test_log_bilinear_is_normalised():
    net = lm.LogBilinear.fresh(np.full(8, 1 / 8))
    x = np.random.default_rng(0).integers(0, 8, (5, lm.CONTEXT))
    total = sum(np.exp(net.log_probabilities(x, np.full(5, k))) for k in range(8))
    assert np.allclose(total, 1, atol=1e-5)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch, docs, texts):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    one, eight = (lm.train(docs.repartition(n, "text")) for n in (1, 8))
    assert (one.net.R == eight.net.R).all() and (one.within.Q == eight.within.Q).all()
    a, b = ({r.doc_id: r.score for r in lm.score(docs.repartition(n), one).collect()} for n in (1, 8))
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-6) for i in a)
    # token by token: the next word's chance by the book
    counts = collections.Counter(w for t in texts.values() for w in [*t.encode().lower().split(), b""])
    code, k = lm.Codes([w for w, _ in one.ranked]), one.classes
    some = [i for i in texts if 3 < len(texts[i].split()) < 40][:5]
    for i in some:
        total, before = 0.0, [one.end] * lm.CONTEXT
        for w in [*texts[i].encode().lower().split(), b""]:
            c = code[w]
            r = sum(one.net.C[j] * one.net.R[k.context[before[-1 - j]]] for j in range(lm.CONTEXT))
            z = np.exp(one.net.Q @ r + one.net.b)
            p = z[k.of[c]] / z.sum()
            lo, hi = k.first[k.of[c]], k.first[k.of[c] + 1]
            z = np.exp(one.within.Q[lo:hi] @ r + one.within.b[lo:hi])
            p *= z[k.entry[c] - lo] / z.sum()
            if c >= min(lm.CLUSTERED, len(one.ranked)):
                others = [x for x in counts if code[x] >= min(lm.CLUSTERED, len(one.ranked)) and k.entry[code[x]] == k.entry[c]]
                p *= (counts[w] + 1) / (sum(counts[x] for x in others) + len(others) + 1)
            total += math.log10(p)
            before.append(c)
        assert math.isclose(total, a[i], rel_tol=1e-4)


def test_noise_contrast_learns_what_follows():
    y = np.tile(np.arange(4), 4000)
    x = np.stack([np.roll(y, j + 1) for j in range(lm.CONTEXT)], 1)
    prior = np.full(4, 0.25)
    net = lm.LogBilinear.fresh(prior)
    for _ in range(150):
        net.train(x, y, prior, np.random.default_rng(1))
    assert net.log_probabilities(x[100:200], y[100:200]).mean() > -0.2


@pytest.mark.parametrize("few", [0, 3])
def test_rare_words_are_joined(spark, monkeypatch, docs, few):
    monkeypatch.setattr(lm, "HOT", few)
    small = docs.limit(30)
    model = lm.train(small)
    told = {r.doc_id: r for r in lm.score(small, model).collect()}
    assert len(model.hot) <= few and all(math.isfinite(r.score) for r in told.values()) and all(r.n_known == r.n_tokens for r in told.values())


def test_repetition_counts(spark, docs, texts):
    got = {r.doc_id: r for r in repetition.op4_quality_rules(spark, SF).collect()}
    for i, t in texts.items():
        words = t.encode().split()
        grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        inside = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.encode().strip()]
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(inside), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r.base_failed and r.kept)
        for n in repetition.LIMITS:
            g = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
            cover = {k + j for k in range(len(words) - n + 1) if g[tuple(words[k : k + n])] > 1 for j in range(n)}
            assert r[f"dup_chars_{n}"] == sum(len(words[k].decode()) for k in cover)


def test_bpe_as_the_library(spark, docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["", " ", "  a  b c", "don't  'll ﬁ 🙂🙂 \n\n x", "=" * 300, "aaaaaaaaaabaaaaaaaab" * 10, "日本語テキスト ٣٤ x́", None, "<|endoftext|>", "a\u0085b c"]
    frame = spark.createDataFrame(list(enumerate([*more, *list(texts.values())[:60]])), "i int, text string")
    coded = bpe.encode(frame, ranks, P.PATTERN).withColumn("back", bpe.decode(F.col("ids"), ranks))
    for r in coded.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()


def test_toxic_sentences_are_learned(spark):
    clean = [f"the cat number {i} sat on the mat. what a fine day {i}. nothing else" for i in range(200)]
    bad = [f"the cat number {i} sat. what a {'worthless' if i % 2 else 'scum'} day {i}. nothing else" for i in range(60)]
    model = toxicity.fit([t.encode() for t in clean + bad], [0] * 200 + [1] * 60)
    assert model.score(b"what a worthless day. fine") > 0.5 > model.score(b"what a fine day. the mat")
    rows = spark.createDataFrame([(1, "A fine day. What a worthless scum. Good."), (2, "All good.")], "doc_id int, text string")
    found = toxicity.offending_sentences(rows, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, 1)]
    p = model.sentence_scores(b"A b. worthless c.")
    assert math.isclose(model.score(b"A b. worthless c."), 1 - np.prod(1 - p), rel_tol=1e-9)


def test_long_clean_texts_stay_clean():
    clean, bad = [f"the cat {i} sat on mat {i % 7}. a fine day" for i in range(200)], [f"the cat {i} sat. you worthless scum {i}" for i in range(60)]
    long = b"a neutral remark of seven plain words. " * 20_000
    for model in (toxicity.fit([t.encode() for t in clean + bad], [0] * 200 + [1] * 60), toxicity.fit([b"one. two"] * 3, [0, 0, 1])):
        assert model.score(long) == model.score(long[:39]) == model.score(b"") < 0.05
    model = toxicity.fit([t.encode() for t in clean + bad], [0] * 200 + [1] * 60)
    none = 1.0
    for words in toxicity.sentences(long + b"worthless words. " + long):
        known = model.weights.keys() & toxicity.features(words)
        none *= 1 - (1 / (1 + math.exp(-model.bias - sum(model.weights[w] for w in known))) if known else 0)
    assert math.isclose(model.score(long + b"worthless words. " + long), 1 - none, rel_tol=1e-9) and none < 0.5


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.9 and got.score.between(0, 1).all()


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(0)
    a, b = (np.unique(hashing.mix(rng.integers(0, 2**63, 2000, dtype=np.uint64))) for _ in range(2))
    both = np.concatenate([a, b])
    assert (neardup.registers(np.unique(both), 64) == neardup.merged(neardup.registers(a, 64), neardup.registers(b, 64))).all()
    x, y = np.unique(np.concatenate([a, b[:300]])), np.unique(np.concatenate([a, b[300:500]]))
    want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    got = neardup.likeliest(neardup.registers(x, 1024)[None], neardup.registers(y, 1024)[None], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(got - want) < 0.05


def _brute(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_by_brute_force(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op7_near_duplicates(spark, SF).collect()}
    assert got == _brute(texts, 3, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_and_large_groups(spark, percent):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts, current = {}, list(base)
    for i in range(40):  # a chain: each differs a little from the one before
        texts[100 + i] = " ".join(current)
        for _ in range(2):
            current[rng.integers(0, len(current))] = f"n{i}"
    for i in range(60):  # a group around one text, pairwise near the threshold
        words = list(base)
        for k in rng.integers(0, len(words), 4):
            words[k] = f"m{i}"
        texts[1000 + i] = " ".join(words)
    texts |= {2000 + i: " ".join(base).upper() for i in range(20)} | {3000: "", 3001: "a", 3002: "A"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, 5, percent).collect()}
    assert got == _brute(texts, 5, percent)


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b]
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for p in pairs for i in p}


def test_languages_of_rows_that_share_an_id_are_learned(spark):
    rows = [(5, "le chat dort", "fr")] * 300 + [(6, f"bonjour {i}", "it") for i in range(300)] + [(i, f"the dog {i}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.train(docs, per_language=10).languages == ["en", "fr", "it"]


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95


def test_gradients_of_the_network():
    net = language.Network.fresh(["a", "b"], 3)
    x = np.random.default_rng(0).integers(97, 110, (4, 6)).astype(np.uint8)
    y = np.array([0, 1, 0, 1])
    _, grads = net.step(x, y)
    for k in ("Uf", "Eb", "W", "c"):
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        net.p[k][i] += 1e-5
        up, _ = net.step(x, y)
        net.p[k][i] -= 2e-5
        down, _ = net.step(x, y)
        net.p[k][i] += 1e-5
        assert math.isclose((up - down) / 2e-5, grads[k][i], rel_tol=1e-3, abs_tol=1e-7)


def test_every_position_has_a_distribution():
    net = language.Network.fresh(["a", "b", "c"], 4)
    text = bytes(np.random.default_rng(1).integers(97, 122, 300).astype(np.uint8))
    q = net.probabilities(np.frombuffer(text, np.uint8)[:, None])
    assert q.shape == (300, 3, 1) and np.allclose(q.sum(1), 1, atol=1e-5)
    assert np.allclose(net.pooled([text, b""])[1], 0) and np.allclose(net.pooled([text])[0].sum(), 1, atol=1e-4)


def test_packing_is_whole_and_tight(spark, docs, texts):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    rows = packing.op9_best_fit_packing(spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = set()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[s : s + 2048] for s in range(0, len(ids), 2048))}
    assert set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(rows) == len(want)
    _check_packed(rows)
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 2048) * 1.03 + 1


def _check_packed(rows, length=2048):
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= length and list(g.offset) == list(np.cumsum(g.length) - g.length)


@pytest.mark.parametrize("sizes", [[2048] * 5, [1] * 5000, [1100] * 50 + [900] * 50 + [48] * 60, [2047, 1, 1]])
def test_packing_of_given_lengths(spark, sizes):
    rows = [(i, 0, 0, n, 1) for i, n in enumerate(sizes)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")).toPandas()
    assert len(packed) == len(sizes)
    _check_packed(packed)
    first_fit = []
    for n in sorted(sizes, reverse=True):
        at = next((k for k, room in enumerate(first_fit) if room >= n), None)
        if at is None:
            first_fit.append(2048 - n)
        else:
            first_fit[at] -= n
    assert packed.sequence_id.nunique() <= len(first_fit)


def _names(manifest):
    return sorted(tuple(r) for r in manifest.collect())


def test_archives_are_whole_and_the_same_again(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = pages.unionByName(pages.limit(20).withColumn("page_id", F.col("page_id") + 100_000))
    names = _names(warc.write_warc(more, f"{tmp_path}/a", roll=20_000, shard_bytes=100_000))
    again = _names(warc.write_warc(more.repartition(7), f"{tmp_path}/b", roll=20_000, shard_bytes=100_000))
    assert len(names) > 3 and names == again and sorted(p.name for p in tmp_path.glob("a/*.gz")) == [n[0] for n in names]
    for n in names:
        data = (tmp_path / "a" / n[0]).read_bytes()
        assert data == (tmp_path / "b" / n[0]).read_bytes() and n[2:] == (len(data), hashlib.sha1(data).hexdigest())
    assert not (tmp_path / "a" / "_temporary").exists()
    got = {r.page: r for r in warc.read_warc(spark, f"{tmp_path}/a").collect()}
    first = {}
    for r in more.orderBy("page_id").collect():
        payload = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        found = got[str(r.page_id)]
        assert (found.payload_bytes, found.payload_digest) == (len(payload), digest)
        if digest in first:
            assert (found.record_type, found.refers_to, bytes(found.payload)) == ("revisit", str(first[digest]), b"")
        else:
            first[digest] = r.page_id
            assert (found.record_type, found.refers_to, bytes(found.payload)) == ("response", None, payload)


def _independent(path):
    """Records by the letter of the format: (type, id, refers-to id, HTTP status line, payload)."""
    data, out = gzip.open(path).read(), []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])}
        block, data = data[: int(fields["content-length"])], data[int(fields["content-length"]) :]
        assert data[:4] == b"\r\n\r\n" and fields["content-type"] == "application/http;msgtype=response"
        http, payload = block.split(b"\r\n\r\n", 1)
        out.append((fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"), http.split(b"\r\n")[0], payload))
        data = data[4:]
    return out


def test_archives_by_an_independent_reader(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/odd/pages.parquet")
    warc.write_warc(pages.unionByName(pages), f"{tmp_path}/w", shard_bytes=1000)
    found = [r for p in sorted(tmp_path.glob("w/*.gz")) for r in _independent(p)]
    assert len(found) == 14 == len({r[1] for r in found})
    stored = {r[1] for r in found if r[0] == "response"}
    assert {r[0] for r in found} == {"response", "revisit"} and all(r[2] in stored and not r[4] for r in found if r[0] == "revisit")
    assert {r[3] for r in found} == {b"HTTP/1.1 200 OK"} and {r[4] for r in found if r[0] == "response"} == {b"<p>same</p>", b"", "é".encode() * 300_000}


def test_archives_of_odd_pages(spark, folder):
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.op10_warc(spark, f"{folder}/odd").collect())
    assert got == [(-1, "response", None, 11), (1, "response", None, 11), (2, "revisit", 1, 11), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 600_000), (5, "revisit", 5, 600_000)]


def test_damaged_archives_are_told():
    good = warc.record("1", "http://a", b"body", warc.base32_sha1(b"body"), None)
    assert [p for _, _, p in warc.records(good)] == [b"body"]
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(good[:-9]))


def test_special_strings_are_tokens_as_in_the_library(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "A<|startoftext|>B <|ENDOFTEXT|> c", "<|EndOfText|>", "x <| endoftext |>", "", None, "plain words, it's"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pieces(frame, packing.default_tokenizer()).collect()}
    library = Tokenizer.from_file(packing.default_tokenizer())
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)}


def test_pieces_of_odd_documents(spark, folder, odd):
    rows = packing.op9_best_fit_packing(spark, f"{folder}/odd").toPandas()
    _check_packed(rows)
    assert sorted(rows[rows.piece == 0].doc_id.fillna(-1)) == sorted(-1 if r.doc_id is None else r.doc_id for r in odd.collect())


def test_extra_columns_stay_and_clashes_are_replaced(spark, odd):
    got = repetition.repetition(odd.withColumn("N_WORDS", F.lit("old")))
    assert [c for c in got.columns if c.lower() == "n_words"] == ["n_words"] and set(odd.columns) <= set(got.columns) and got.count() == odd.count()


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
