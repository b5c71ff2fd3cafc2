"""Awkward rows: strings of added tokens, equal hashes, null and repeated ids, ties, large groups, and the whole pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluorite.llm import common, decontamination, language, lm_scoring, ngram_join, packing, pseudonyms, sharding, suffix_dedup, token_output, tokenise


def thue_morse(n: int) -> bytes:
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


def test_hashes_of_complementary_words_differ():
    """The two words of 1024 letters whose polynomial hashes modulo a power of two agree, whatever the base."""
    one = thue_morse(1024)
    two = one.translate(bytes.maketrans(b"ab", b"ba"))
    words = common.Words(pa.array([one.decode(), two.decode(), one[:200].decode(), two[:200].decode()]))
    assert len(set(words.hashes.tolist())) == 4
    data = np.frombuffer(one + two, np.uint8)
    grams = common.hash_grams(common.eights(data), 512)
    assert grams[0] != grams[1024]


def test_hash_ranges_tell_bytes_apart():
    rng = random.Random(1)
    texts = list({bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 40))) for _ in range(5000)}) + [b"a" * k for k in range(200, 300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    hashes = common.hash_ranges(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(texts))
    assert (common.hash_ranges(np.concatenate([data, data]), starts + len(data), ends + len(data)) == hashes).all()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name):
    """Contractions, all kinds of white space, added tokens' strings, odd characters, long words and long texts."""
    from tokenizers import Tokenizer

    path = tokenise.vocabulary(name)
    library, own, rng = Tokenizer.from_file(path), tokenise.Encoder(path), random.Random(7)
    bits = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "\r\n", "a", "B", "don", "é", "Ÿ", "ß", "1", "42", "½", "²", "!", "..", "\xad", "×", "ª"]
    bits += ["<|", "<|endoftext|>", "<|startoftext|>", "日", "İ", "Ⱥ", "\xa0", "\x07", "\x00", "word", "averyverylongwordindeedmorethansixteen", "_", "''s", "́", "Ǆ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + [None, "", "hello <|endoftext|> world", "word " * 300_000]
    ids, at = own.encode(texts, 2)
    for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()):
        assert ids[a : b - 1].tolist() == library.encode(text or "", add_special_tokens=False).ids and ids[b - 1] == 2, text[:100]


def test_a_full_store_of_pretokens_starts_anew(monkeypatch):
    monkeypatch.setattr(tokenise, "CELLS", 64)
    monkeypatch.setattr(tokenise, "GROUP_BYTES", 100)
    path = tokenise.vocabulary("byte_bpe_50k.json")
    own, fresh = tokenise.Encoder(path), tokenise.Encoder
    texts = [" ".join(f"w{i}x{k}" for i in range(3)) for k in range(60)]
    ids, at = own.encode(texts, 2)
    assert own.number < 60 and all(ids[a:b].tolist() == fresh(path).encode([t], 2)[0].tolist() for t, a, b in zip(texts[::20], at[:-1:20], at[1::20]))


def test_op1_scores_of_null_and_repeated_ids(spark):
    rows = [(None, "some words"), (None, "other words"), (3, "some words"), (3, "some words"), (4, None), (5, ""), (6, "Ünïcode " * 5000)]
    got = lm_scoring.score_texts(spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, score int, p int").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and not any(r.held_out for r in got if r.doc_id is None)


def say(lang: int, n: int, rng: random.Random) -> str:
    return " ".join(rng.choice([["ba", "ab", "aba", "baab"], ["zy", "yz", "xyz", "zzyx"]][lang]) for _ in range(n))


def test_op2_against_plain_vectors(spark):
    """Predictions and scores from bundles made letter by letter, with a long text, null langs, and repeated rows."""
    rng = random.Random(5)
    rows = [(i, say(i % 2, rng.randint(1, 30), rng), ("aa", "zz", None)[i % 2 if i % 7 else 2]) for i in range(60)]
    rows += [(100, say(0, 20_000, rng), "aa"), (None, "ab ba", "aa"), (None, "Zy-Yz!", "zz"), (3, "xyz", "zz"), (3, "xyz", "zz"), (200, "", "aa"), (201, None, None), (202, "1 2 3", "zz")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    space = language.Space(1024, 7)

    def bundle(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        line = " " + " ".join(words) + " "
        out = np.zeros(1024)
        for a, b, c in zip(line, line[1:], line[2:]) if words else ():
            out += np.roll(space.letter(ord(a)), 2).astype(float) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
        return out

    profile = {}
    for k, text, lang in rows:
        if lang and text is not None and (k is None or zlib.crc32(str(k).encode()) % 4 != 2):
            profile[lang] = profile.get(lang, 0) + bundle(text)
    want = Counter()
    for k, text, _ in rows:
        v = bundle(text)
        found = max((v @ p / np.linalg.norm(v) / np.linalg.norm(p), lang) for lang, p in profile.items()) if v.any() else (0.0, "und")
        want[k, found[1], round(max(0.0, found[0]), 4)] += 1
    got = language.identify(df).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in got) == want


def test_language_stage_without_labels_keeps_texts(spark):
    docs = spark.createDataFrame([(i, "plain words here", None) for i in range(8)] + [(9, "12 !", None), (10, None, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.keep_identified(docs).collect()) == list(range(8))


def test_op3_null_long_and_repeated_rows(spark):
    card = "4111 1111 1111 1111"
    rows = [(None, card), (None, card), (1, "x " * 100_000 + card + " y"), (2, None), (3, "")]
    got = pseudonyms.pseudonymise(spark.createDataFrame([(*r, "q", "k") for r in rows], "doc_id long, text string, value string, kind string"), "key").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and not any(card in (r.text or "") for r in got)
    (new,) = {r.text for r in got if r.doc_id is None}
    assert next(r.text for r in got if r.doc_id == 1) == "x " * 100_000 + new + " y"


def test_op4_ties(spark):
    rows = [(None, "a"), (None, "a"), (5, "b" * 10_000), (5, "b"), (6, None), (7, "")]
    got = sharding.shard_by_bytes(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int").repartition(3)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((k, len((t or "").encode()) + 1) for k, t in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_op5_repeated_and_null_ids_round_trip(spark):
    rows = [(None, "null one"), (4, "b"), (4, "a"), (4, "a"), (2, None), (3, "x " * 40_000)]
    got = token_output.token_digest(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)).collect()
    ids, at = tokenise.Encoder(tokenise.vocabulary("byte_bpe_50k.json")).encode([t for _, t in rows], 2)
    want = Counter((k, int(b - a), zlib.crc32(ids[a:b].astype("<u4").tobytes())) for (k, _), a, b in zip(rows, at[:-1], at[1:]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [None, 2, 3, 4, 4, 4]


@pytest.mark.parametrize("hot", [8192, 10, 1])
def test_op6_against_all_windows(spark, hot):
    """Also names that many documents have, whose windows go one by one; runs of a byte, copies, null and repeated ids."""
    rng = random.Random(3)
    make = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    passage = make(40)
    rows = [(i, make(rng.randint(0, 60))) for i in range(60)] + [(100 + i, make(20) + passage + make(rng.randint(0, 9))) for i in range(30)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300, None), (301, "a" * 700), (302, "a" * 300), (303, "b" + "a" * 400), (304, "é" * 100), (305, "")]
    rows += [(7, rows[7][1]), (8, passage), (None, passage + " end")]
    key = lambda k: -1 if k is None else k
    raw = [(key(k), (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in sorted(raw):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    want = Counter()
    for (name, _), (k, b) in zip(rows, raw):
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                m[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, m) if not g)
        want[name, len(b), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[0]), hashlib.sha256(kept).hexdigest()] += 1
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, p int, digest string").repartition(5)
    assert Counter(tuple(r) for r in suffix_dedup.repeat_digest(docs, hot=hot).collect()) == want


@pytest.mark.parametrize("length", [3, 7, 20, 50])
def test_op6_order_ends_at_the_length(length):
    """Suffixes are ordered by no more bytes than a repeat has, and the expansion starts from the intervals that the sort leaves."""
    rng = np.random.default_rng(length)
    base = rng.integers(0, 3, 400).astype(np.uint8)
    strings = [base[a : a + n].copy() for a, n in zip(rng.integers(0, 200, 12), rng.integers(length, 200, 12))]
    for s in strings[::2]:
        s[len(s) // 2] = 255
    sizes, whole = np.array([len(s) for s in strings]), np.concatenate(strings)
    order, low, high, depth = suffix_dedup.suffix_order(whole, sizes, length)
    assert sorted(order.tolist()) == list(range(len(whole))) and depth == {3: 3, 7: 7, 20: 14, 50: 28}[length]
    ends = np.repeat(np.cumsum(sizes), sizes)
    cut = lambda i, n: whole[i : min(i + n, ends[i])].tobytes()
    assert [cut(i, length) for i in order] == sorted(cut(i, length) for i in order)
    assert all(len({cut(i, depth) for i in order[a:b]}) == 1 for a, b in zip(low, high))
    want: dict[bytes, list] = {}
    for i in range(len(whole)):
        if ends[i] - i >= length:
            want.setdefault(cut(i, length), []).append(i)
    got: dict[int, list] = {}
    for k, i in zip(*map(np.ndarray.tolist, suffix_dedup.repeated(whole, sizes, length))):
        got.setdefault(k, []).append(i)
    assert sorted(map(sorted, got.values())) == sorted(w for w in want.values() if len(w) > 1)


def test_op8_plans_are_whole_and_tight():
    """All pieces have a place, none overlap, and sequences are no more than first-fit decreasing needs."""
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([20, 50, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([3, 50, 400])) for _ in range(rng.randint(1, 40))}
        plan = packing.Plan(dict(counts), capacity)
        fill = {}
        for size, places in plan.places.items():
            assert sum(b * e for _, b, e, _, _ in places) == counts[size]
            for _, bins, each, start, offset in places:
                for q in range(bins):
                    fill.setdefault(start + q, []).extend((offset + x * size, size) for x in range(each))
        for parts in fill.values():
            parts.sort()
            assert [p for p, _ in parts] == [sum(s for _, s in parts[:i]) for i in range(len(parts))] and sum(s for _, s in parts) <= capacity
        rooms = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                k = next((k for k, room in enumerate(rooms) if room >= size), None)
                if k is None:
                    rooms.append(capacity)
                    k = len(rooms) - 1
                rooms[k] -= size
        least = math.ceil(sum(s * n for s, n in counts.items()) / capacity)
        assert least <= plan.sequences == len(fill) <= math.ceil(1.02 * len(rooms)) + 1
    steps = packing.Plan({2040: 10**6, 5: 10**6, 6: 10**6, 700: 10**6}, 2048)
    assert steps.sequences == 1_500_000 and sum(map(len, steps.places.values())) < 50  # few steps, however many pieces


def optimum(sizes: list[int], capacity: int) -> int:
    """The fewest sequences, by trying all ways."""
    best = [len(sizes)]

    def place(k: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - sizes[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_op8_fixed_sets_are_in_an_optimum():
    """What the reduction fixes, with the fewest sequences for the rest, is the optimum of the whole."""
    rng = random.Random(8)
    for _ in range(120):
        sizes = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.Plan(dict(Counter(sizes)), 20)
        rest = []
        for size, places in plan.places.items():
            rest += [size] * sum(b * e for _, b, e, start, _ in places if start >= plan.fixed)
        assert plan.fixed + optimum(sorted(rest, reverse=True), 20) == optimum(sizes, 20)


def components_by_pairs(rows):
    """(doc_id, shingles, component_id) of (doc_id, text) rows by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block, bits", [(512, 64), (3, 64), (512, 3)])
def test_op9_large_trees_and_equal_names(spark, monkeypatch, block, bits):
    """Trees cut into blocks of three members, and names of three bits, so that most sets share theirs with another."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block + bits)
    rows = []
    for g in range(20):
        base = [f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 80))]
        for _ in range(25 if g == 0 else rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w[: max(1, int(len(w) * rng.choice([1, 1, 1, 0.8])))])))
    rows += [(500, None), (501, " "), (502, rows[0][1]), (502, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, class int, n int").repartition(3)
    assert Counter(tuple(r) for r in ngram_join.ngram_components(docs, bits=bits).collect()) == components_by_pairs(rows)


def test_op9_words_without_common_letters_do_not_link(spark):
    one = thue_morse(1024).decode()
    rows = [(1, " ".join([one] * 3)), (2, " ".join([one.translate(str.maketrans("ab", "ba"))] * 3))]
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: 1, 2: 2}


def test_op10_against_all_windows(spark):
    """Items found are those that some window of a document reaches, by comparing all windows with all items."""
    rng = random.Random(6)
    make = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [make(rng.randint(8, 60)) for _ in range(25)]
    rows = []
    for k in range(80):
        text = make(rng.randint(0, 150))
        if k % 2:
            part = list(rng.choice(items))
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "new"
            text[len(text) // 2 : len(text) // 2] = part
        rows.append((k if k % 9 else None, " ".join(text)))
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    want = Counter()
    for k, text in rows:
        w = text.split()
        for n, item in enumerate(items):
            best = 0.0
            for start in range(max(1, len(w) - len(item) + 1)) if w else ():
                a, b = bag(w[start : start + len(item)]), bag(item)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.75:
                want[k, n, round(best, 9)] += 1
    table = spark.createDataFrame([(n, " ".join(w), n) for n, w in enumerate(items)] + [(0, " ".join(items[0]), 0)], "item_id long, text string, doc_id int")
    got = decontamination.contaminated(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), table).collect()
    twice = Counter((k, n, s) for (k, n, s), c in want.items() for _ in range(c * (2 if n == 0 else 1)))  # item 0 is in the table twice
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == twice and len(want) > 10


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Five stages over null ids, copies, near copies, benchmark passages, numbers, and texts without letters."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(9)
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(i if i % 10 else None, f"{say(i % 2, 3, rng)} t{i} " + " ".join(f"u{i}x{k}" for k in range(20)), ("aa", "zz")[i % 2]) for i in range(40)]
    rows += [(100, rows[1][1] + " more", "aa"), (101, rows[2][1], "aa"), (102, f"ab ba {item} ab", "aa"), (103, "ab aba card 4111 1111 1111 1111 ba", None)]
    rows += [(104, "12 !", "aa"), (105, None, None), (106, "", "zz"), (107, "ab " * 3000, "aa"), (107, "zy " * 10, "zz")]
    frame = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pseudonyms", "packing"]
    kept = [(k, t) for k, t, _ in rows if t and any(c.isalpha() for c in t)]
    gone = {(100, rows[1][1] + " more"), (101, rows[2][1])}  # of near copies the smaller ids stay
    kept = [r for r in kept if r not in gone and item not in r[1]]
    library = Tokenizer.from_file(tokenise.vocabulary("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length) for r in got)
    want = Counter()
    for k, t in kept:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        want.update((k, p, a, min(2048, n - a)) for p, a in enumerate(range(0, n, 2048)))
    card = {p for p in want if p[0] == 103}
    assert Counter({p: c for p, c in pieces.items() if p[0] != 103}) == Counter({p: c for p, c in want.items() if p not in card})
    assert sum(c for p, c in pieces.items() if p[0] == 103) == 1
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert [p for p, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    clean = corpus_pipeline.pseudonymise_values(spark, docs, str(tmp_path))
    assert clean.where("doc_id != 103 or doc_id is null").exceptAll(docs).count() == 0
    assert "4111" not in clean.where("doc_id = 103").first().text
