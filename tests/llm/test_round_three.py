"""Periodic runs, spelling variants and token counts against brute force and against the library."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from logloom.llm import counts, packing, periods, variants

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def _runs(words, least):
    """All maximal stretches with a period, by trying each period; the smallest one of a stretch is its own."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, 2 * p) and i > start:
                out.setdefault((start, i - start + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def _repetitive(rng):
    size, kinds = rng.randrange(120), rng.choice([1, 2, 3, 30])
    words = [b"%d" % rng.randrange(kinds) for _ in range(size)]
    if size and rng.random() < 0.7:
        a, p = rng.randrange(size), rng.randrange(1, 30)
        words = words[:a] + words[a : a + p] * rng.randrange(1, 6) + words[a:]
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 20])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(least)
    many = [_repetitive(rng) for _ in range(400)]
    found = periods.find(many, least)
    assert sum(map(len, found)) > 200
    assert found == [_runs(words, least) for words in many]


def test_runs_do_not_depend_on_what_is_appended_at_once():
    rng = random.Random(3)
    values = np.array([rng.randrange(2) for _ in range(200)] * 2 + [7] * 50 + [1, 2, 3] * 40, np.uint64)

    def by(step):
        catchers, told = periods.Catchers(len(values)), []
        for i in range(0, len(values), step):
            catchers.append(values[i : i + step])
            told.append(catchers.runs().tolist())
        return told

    whole = by(len(values))[-1]
    assert whole == [list(r) for r in _runs(values.tolist(), periods.LEAST)]
    for step in (1, 2, 7, 64):
        told = by(step)
        assert told[-1] == whole
        for i, runs in list(enumerate(told))[:: max(1, len(told) // 20)]:  # at any time those of the text so far
            assert runs == [list(r) for r in _runs(values.tolist()[: (i + 1) * step], periods.LEAST)]


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    first = periods._caught
    monkeypatch.setattr(periods, "_caught", lambda texts, salt, least: first([np.zeros(len(t), np.uint64) for t in texts] if salt == 0 else texts, salt, least))
    words = [b"a", b"b", b"c"] * 6
    assert periods.find([words], 12) == [[(0, 18, 3)]]


def test_long_repetitive_texts_end():
    assert periods.find([[b"x"] * 200_000, b"Some words of a long text again".split() * 20_000]) == [[(0, 200_000, 1)], [(0, 140_000, 7)]]


def test_periodic_runs_of_documents(spark, texts):
    got = {r.doc_id: r for r in periods.op11_periodic_runs(spark, SF).collect()}
    assert got.keys() == texts.keys()
    changed = 0
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
            changed += 1
        runs = _runs(words, 12) if n < 1500 or h % 10 == 0 else None
        if runs is None:
            continue
        held = {k for s, size, p in runs for k in range(s + p, s + size)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (None if top[0] is None else 1000 * top[1] // top[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in held).encode()).hexdigest()
    assert changed > 5 and sum(r.n_runs > 0 for r in got.values()) > 5


def test_periodic_runs_of_odd_rows(spark, odd):
    rows = periods.periodic_runs(odd, id_column="id").collect()  # another id column, of ints
    assert len(rows) == odd.count() and all(r.doc_id == 7 and r.runs_sha256 for r in rows)
    by_id = collections.defaultdict(list)
    for r in periods.periodic_runs(odd).collect():
        by_id[r.doc_id].append(r)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) == (0, None, nothing, nothing) for i in (2, 3, 9) for r in by_id[i])
    assert by_id[6][0] == by_id[6][1] and by_id[4][0].period == 9 and len(by_id[None]) == 1


def _one_letter_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _grouped(n):
    """near words, form and root by comparing all words that agree somewhere."""
    sharing = collections.defaultdict(set)
    for w in n:
        for i in range(len(w) + 1):
            sharing[w[:i], w[i + 1 :]].add(w)
            sharing[w[:i], w[i:]].add(w)
    near = {w: set() for w in n}
    for group in sharing.values():
        for w in group:
            near[w] |= {x for x in group if x not in near[w] and x != w and _one_letter_apart(w, x)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def _rows(df):
    got = df.collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_spelling_variants_of_documents(spark, texts):
    n = collections.Counter()
    for i, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    want = _grouped({w: k for w, k in n.items() if len(w) >= 5 and k >= 3})
    assert any(r[1] != r[0] for r in want.values() if r[0])  # some chain has two steps
    assert _rows(variants.op12_spelling_variants(spark, SF)) == want


def test_spelling_variants_in_rounds_ties_and_chains(spark):
    letters = "aàz×"
    rng = random.Random(9)
    n = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))): rng.choice([1, 1, 2, 4, 8, 16, 33]) for _ in range(400)}
    n |= {"x" * 70: 1, "x" * 71: 2, "x" * 69 + "y": 4, "x" * 69 + "yz": 9}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = _grouped(n)
    assert _rows(variants.roots(variants.forms(words, variants.neighbours(words)))) == want
    # 4,096 blocks a round; with more bits for each word these few words fill several rounds
    try:
        bits, variants.BITS = variants.BITS, 64 * 40
        assert variants.Shards({5: len(n)}).total > 4 * variants.SEGMENT // 2
        assert _rows(variants.roots(variants.forms(words, variants.neighbours(words, 1)))) == want
    finally:
        variants.BITS = bits


def test_spelling_variants_of_odd_rows(spark, odd, none):
    got = _rows(variants.spelling_variants(odd, 3, 2, edit=variants.misspelt))
    n = collections.Counter()
    for r in odd.collect():
        for w in re.findall("[a-zà-ÿ]+", (r.text or "").lower()):
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            n[w if h % 97 or r.doc_id is None else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert got == _grouped({w: k for w, k in n.items() if len(w) >= 3 and k >= 2}) and len(got) > 10
    assert variants.spelling_variants(none).count() == 0 and variants.spelling_variants(odd.filter("text IS NULL")).count() == 0


def test_token_counts_are_the_librarys():
    path = public_tokenizers.path(counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    letters = "ab cd  \n\t▁éÀ漢字　<s></s><0x0A>1230  xẍ‍😀🏽\0"
    many = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)]
    many += ["", " ", "\n", " \n", "\n ", "a ", " a", "a" * 50_000, "漢字" * 20_000, "  " * 5000, "ab" * 3000 + " ", "\n" * 5000]
    count = counts.Sentences(path)
    assert count.cuts
    want = [len(library.encode(t)) for t in many]
    assert count([t.encode() for t in many]) == want
    assert count([t.encode() for t in many]) == want  # out of the memo
    count.forget()
    count.cuts = False
    assert count._parts("ab" * 3000)[0] and "".join(count._parts("漢字" * 3000)) == "漢字" * 3000


def test_token_counts_of_documents(spark, texts, odd):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(counts.MODEL))
    got = counts.op13_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    assert any(r.over_limit for r in got)
    clashing = odd.selectExpr("*", "'x' AS N_TOKENS", "1 AS over_limit")
    rows = counts.token_counts(clashing, public_tokenizers.path("byte_bpe_50k.json"), limit=0)
    assert rows.columns == [*odd.columns, "n_bytes", "n_tokens", "over_limit"]
    model = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows.collect():
        assert r.n_tokens == len(model.encode(r.text or "", add_special_tokens=False).ids) and r.over_limit == bool(r.text)


def test_packing_ids_are_the_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = tokenizers.Tokenizer.from_file(path), packing._Encoder(path)
    rng = random.Random(7)
    letters = [*"abTHJWYtß éÉİıĞ\n\t.,'!’-0", "̈", "̱", "̇", "̌", "́", *"ﬁΣς漢한각", " ", "　", "😀", "Å", "K", "‍", "٣", "<|startoftext|>", "Ǆ"]
    many = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(5000)] + ["EKONOMİ.", "T̈a.", "H̱", "ALİ'nin", "İ"]
    got = [ids for i in range(0, len(many), 250) for ids in encoder([t.encode() for t in many[i : i + 250]])]
    assert got == [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in many]


@pytest.mark.parametrize("seed", range(20))
def test_small_pieces_have_one_place_each(seed):
    rng = random.Random(seed)
    counts = np.zeros(2049, np.int64)
    for _ in range(rng.randrange(1, 30)):
        counts[rng.randrange(1, 257)] += rng.randrange(1, 40)
    rooms = {rng.randrange(2048): rng.randrange(1, 30) for _ in range(rng.randrange(10))}
    rows, kinds = packing.small_plan(counts, rooms, 2048, 256)
    of = {kind: (room, first) for kind, room, first, _ in kinds}
    placed, filled = collections.Counter(), collections.Counter()
    for n, rank, times, kind, _, _ in rows:
        for k in range(times):
            placed[n, rank + k] += 1
            filled[of[kind][0], of[kind][1] + k] += n
    assert placed == collections.Counter((n, r) for n in range(257) for r in range(counts[n]))
    assert all(total <= room and (room == 2048 or first < rooms[room]) for (room, first), total in filled.items())
