"""The ten operators against brute force, the tokenizers' own libraries, and odd tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PARTS = list("abcdesrtvml'''   \n\t\r..!?019é½ﬁ▁你🙂ÀÉ  \u0085İK₂<|>") + ["'re", "'ll", "'s", "<|endoftext|>", "</s>", "the", "  ", "\x00", "́"]


def random_texts(n, parts=PARTS, most=50, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# 5 and 10: the libraries' own results


def test_token_counts_equal_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    from matchflow.llm.token_counts import compiled, count_tokens

    library = Tokenizer.from_file(BYTE_BPE)
    texts = [*random_texts(3000), "a" * 5000, " " * 3000, "x  \n\n y\n", ""]
    assert compiled(BYTE_BPE).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, BYTE_BPE).collect()}
    assert rows == {(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in odd.collect()}
    assert count_tokens(empty, BYTE_BPE).count() == 0


def test_chunk_maps_do_not_depend_on_the_chunk():
    from matchflow.llm.token_counts import character_classes, pretoken_starts, symbols

    text = "".join(random_texts(300))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes), bool)
    first[0] = True
    syms = symbols(codes, first, character_classes())
    assert all(np.array_equal(pretoken_starts(syms, c), pretoken_starts(syms, 10**6)) for c in (1, 7, 64))


def test_pieces_equal_the_library_both_ways(spark, odd, empty):
    import sentencepiece

    from matchflow.llm.pieces import decode_pieces, encode_pieces, piece_table, piece_writer, pieces_round_trip

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    table = piece_table(PIECE_BPE)
    for text in random_texts(3000):
        ids = table.encode(text)
        assert ids == [*library.encode(text), library.eos_id()]
        assert piece_writer(PIECE_BPE).decode(ids) == library.decode(ids)
    rows = decode_pieces(encode_pieces(odd, PIECE_BPE), PIECE_BPE).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted((str(r.doc_id), ids := [*library.encode(r.text or ""), 2], library.decode(ids)) for r in odd.collect())
    assert sorted(map(str, pieces_round_trip(odd, PIECE_BPE).collect())) == sorted(map(str, rows))
    assert decode_pieces(encode_pieces(empty, PIECE_BPE), PIECE_BPE).count() == 0


# 2: edit distances by the full table


def least_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force():
    from matchflow.llm.decontamination import Matcher, normal

    rng = random.Random(3)
    for _ in range(300):
        item = normal("".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))) or "a"
        edited = list(item)
        for _ in range(rng.randint(0, 7)):
            k = rng.randint(0, len(edited))
            edited[k : k + rng.randint(0, 1)] = rng.choice("abcd") * rng.randint(0, 1)
        noise = lambda: "".join(rng.choice("abcd ") for _ in range(30))
        text = normal(noise() + "".join(edited) + noise())
        want, got = least_distance(item, text), Matcher([(1, item)], 0.1).leaks(text)
        assert [x["distance"] for x in got] == ([want] if want <= int(len(item) * 0.1) else [])


def test_leaks_of_odd_tables(spark, odd, empty):
    from matchflow.llm.decontamination import find_leaks

    bench = spark.createDataFrame([(1, "QUICK  brown fox jumps\nover the lazy dog"), (2, None), (3, " "), (4, "quick brown fox jumps over the lazy dog"), (None, "one")], "item_id long, text string")
    for chars in (10, 4_000_000):  # one block an item, and one for all
        found = {(r.doc_id, tuple(sorted((x.item_id, x.distance) for x in r.leaks))) for r in find_leaks(odd, bench, block_chars=chars).collect()}
        assert {d for d, x in found if x} == {1, 5} and all(x == ((1, 0), (4, 0)) for d, x in found if x)
    assert find_leaks(odd, bench.limit(0)).count() == odd.count()
    assert find_leaks(empty, bench).count() == 0


# 3: archives, whole and damaged


def test_archives_come_back(spark, tmp_path):
    from matchflow.llm.warc import digest, read_warc, write_warc

    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nv", ""), (5, "c", "é" * 100000), (None, "d", "only"), (7, "e", "<p>x</p>"), (7, "e", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS member")
    write_warc(pages, f"file://{tmp_path}/a")
    got = read_warc(spark, f"file://{tmp_path}/a").collect()
    assert not any(r.reason for r in got)
    want = collections.Counter()
    for i, _, html in rows:
        keeper = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        refers = None if i == keeper else f"<urn:page:{keeper}>"
        want[f"<urn:page:{'' if i is None else i}>", "revisit" if refers else "response", refers, digest((html or "").encode()), len((html or "").encode())] += 1
    assert collections.Counter((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got) == want
    write_warc(pages.limit(0), f"file://{tmp_path}/b")
    assert read_warc(spark, f"file://{tmp_path}/b").count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    from matchflow.llm.warc import read_warc, write_warc

    rows = [(i, "u", f"{i} " * (2000 if i % 50 == 0 else 50)) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(pages, f"file://{tmp_path}/a", file_bytes=20_000, small_page=500)
    payloads = collections.Counter()
    for r in read_warc(spark, f"file://{tmp_path}/a").collect():
        assert r.reason is None
        payloads[r.file] += r.payload_bytes
    assert sum(payloads.values()) == sum(len(h) for _, _, h in rows) and max(payloads.values()) <= 20_000


def test_damaged_heads_take_linear_time():
    import time

    from matchflow.llm.warc import records_inside, salvage

    took = []
    for size in (1_000_000, 8_000_000):
        data = b"WARC/1.1\r\nno end here\r\n" * (size // 23)
        began = time.perf_counter()
        found = list(salvage(data))
        assert [f[2:] for f in found] == [(None, "header without an end")] and records_inside(data, False)[0] == []
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 5


def test_a_block_is_forgotten_after_use():
    from matchflow.llm.decontamination import released

    class Stored:
        _path = "file"

        @property
        def value(self):
            self._value = [(1, "item")]
            return self._value

    block = Stored()
    assert released(block, len) == 1 and not hasattr(block, "_value")


def test_salvage_goes_on_behind_damage():
    from matchflow.llm.warc import member, record, salvage

    one = [record(i, "u", f"payload {i} ".encode() * 50, None, "2024-01-01T00:00:00Z") for i in range(6)]
    zipped = [member(x) for x in one]
    bad = bytearray(zipped[2])
    bad[len(bad) // 2] ^= 255
    cut = one[4][: len(one[4]) // 2]
    parts = [zipped[0], b"\x00junk", zipped[1], bytes(bad), one[3], cut, one[5], zipped[0][:40]]
    found = list(salvage(b"".join(parts)))
    assert [x["record_id"] for _, _, x, _ in found if x] == [f"<urn:page:{i}>" for i in (0, 1, 3, 5)]
    assert [(a, n) for a, n, _, why in found if why] == [(sum(map(len, parts[:k])), len(parts[k])) for k in (1, 3, 5, 7)]
    assert sum(n for _, n, _, _ in found) == sum(map(len, parts))


def test_salvage_inside_a_member_of_several_records():
    import gzip
    import random

    from matchflow.llm.warc import member, record, salvage

    rng = random.Random(3)
    one = [record(i, "u", rng.randbytes(2000).hex().encode(), None, "2024-01-01T00:00:00Z") for i in range(5)]
    wrong = one[2].replace(b"\r\n\r\nHTTP", b"\r\n\r\nHTTQ")

    def ids(data):
        found = list(salvage(data))
        return [int(x["record_id"][10:-1]) for _, _, x, _ in found if x], [why for _, _, _, why in found if why]

    assert ids(gzip.compress(b"".join([*one[:2], wrong, *one[3:]]))) == ([0, 1, 3, 4], ["block digest differs"])
    assert ids(gzip.compress(b"".join(one[:2]) + b"junk" + one[3])) == ([0, 1, 3], ["no version line"])
    for level in (0, 9):
        whole, end = gzip.compress(b"".join(one[:4]), level), member(one[4])
        crc = whole[:-8] + bytes([whole[-8] ^ 255]) + whole[-7:]
        kept, why = ids(crc + end)
        assert kept == [0, 1, 2, 3, 4] and len(why) == 1 and why[0].startswith("gzip")
        kept, why = ids(whole[: len(whole) * 5 // 8] + end)
        assert kept == [0, 1, 4] and len(why) == 1 and why[0].startswith("gzip")
    assert ids(whole[: len(whole) * 5 // 8]) == ([0, 1], ["gzip: cut off"])


# 7: secrets by plain patterns


def test_secrets_equal_plain_patterns(spark, odd, empty):
    from matchflow.llm import secret_scan as S

    automaton = S.keyword_automaton()
    plain = {"assign": S.ASSIGN, "access": S.ACCESS, "hex": re.compile("[0-9a-f]+")}
    least = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    parts = ["password", "token", "SECRET", "api_key", "apikey", "AKIA", "=", ":", " ", '"', "'", "ABCDEFGH12345", "deadbeef", "0123", "İ", "K", "ſ", "é", "abcdefabcdef0123"]
    for text in random_texts(5000, parts, 14):
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(plain.items()) for m in p.finditer(text) if least[kind](m))
        assert [x for x in S.scan(text, automaton) if x[0] in S.BASE_KINDS] == [(kind, a, b) for a, _, kind, b in want]
    body = "A1" * 15
    key = f"ghp_{body}{S.checksum(body)}"
    assert ("forge", 3, 43) in S.scan(f"my {key}", automaton) and not S.scan(f"my {key[:-1]}!", automaton)
    found = S.find_secrets(odd, keep=("doc_id", "text", "n_chars"))
    masked = {r.doc_id: (r.text, r.n_chars) for r in S.masked(found).collect()}
    assert masked[None] == ("a row without an id [SECRET] in it", 34)
    assert masked[2] == (None, None) and masked[1][1] == 63
    assert S.find_secrets(empty).count() == 0


# 8: fingerprints


def test_fingerprints_locate_edits(spark, odd, empty):
    from matchflow.llm.merkle import document_fingerprints, with_next_text

    nexts = [(r.doc_id, r.text, r.next_text) for r in with_next_text(odd).collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    want = [(d if known else None, t, rows[(k + 1) % len(rows)][2]) for k, (known, d, t) in enumerate(rows)]
    assert collections.Counter(nexts) == collections.Counter(want)
    found = document_fingerprints(odd).collect()
    prints = collections.defaultdict(set)
    for r in found:
        prints[r.doc_id].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[1] == prints[5] and len(prints[5]) == 1 and prints[2] == prints[3]
    assert document_fingerprints(empty).count() == 0
    a, b = ({r.doc_id: r.fingerprint for r in document_fingerprints(spark.createDataFrame([(1, t), (2, "z")], "doc_id long, text string")).collect()}[1] for t in ("One a, b.\nzwei, drei.\nThree c.", "One a, b.\nzwei, vier.\nThree c."))
    sections = [x.partition(":")[2].split(";") for x in (a, b)]
    assert [x == y for x, y in zip(*sections, strict=True)] == [False, True]
    assert a[:64] != b[:64]


def plain_fingerprint(text):
    """The tree of one text, written out."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = text.replace("\2", "\2b").replace("\1", "\2a")
    sections = [[]]
    for k, line in enumerate(text.split("\n")):
        if k and (line == "" and k < text.count("\n") or line[:1] in "#AEIOULRT" and line):
            sections.append([])
        sections[-1].append(line)
    # a blank line opens a section, and its break stands before the next line
    out = []
    for lines in sections:
        out.append([[sha(c) for c in re.split(r"(?<=[^\w\s]) |(?<=_) ", line)] for line in lines])
    lines = [[sha("".join(p)) for p in s] for s in out]
    heads = [sha("".join(s)) for s in lines]
    tree = ";".join(h[:8] + "=" + ",".join(q[:8] + "." + "".join(c[:8] for c in p) for q, p in zip(ls, s, strict=True)) for h, ls, s in zip(heads, lines, out, strict=True))
    return f"{sha(''.join(heads))}:{tree}"


def test_fingerprints_equal_a_plain_tree(spark):
    from pyspark.sql import functions as F

    from matchflow.llm.merkle import with_fingerprint

    parts = ["One, two. ", "three; four", "\nA line. Of it", "\nplain (x) y", "\n# head", "_ z", "\1", "\2", "ü. Ö", " "]
    texts = random_texts(200, parts, 8) + ["", "x.\1y", "x. y", "x.\2ay"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.fingerprint for r in with_fingerprint(df, "text", "fingerprint", "leaves").select("i", F.col("fingerprint")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]
    assert len({got[i] for i in range(len(texts))}) == len({*texts})


def test_next_text_over_many_ranges(spark, monkeypatch):
    from matchflow.llm import merkle

    monkeypatch.setattr(merkle, "BUCKET_ROWS", 7)
    ids = random.Random(5).sample(range(10**6), 200)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids)
    assert {(r.doc_id, r.next_text) for r in merkle.with_next_text(docs).collect()} == {(i, f"t{order[(k + 1) % 200]}") for k, i in enumerate(order)}


# 9: fingerprints and components by brute force


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint). The smallest id reachable, for each row."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        least[r].append(i)
    return [min((x for x in least[r] if x is not None), default=None) for r in root]


def test_components_equal_brute_force(spark, odd, empty, monkeypatch):
    from matchflow.llm import simhash

    assert all(simhash.fingerprint(t) == brute_fingerprint(t) for t in random_texts(300, ["ab", "C", " ", "\n", "É", "x y z w v "], 40))
    monkeypatch.setattr(simhash, "TILE", 8)  # many tiles
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains and clouds around the first
        prints.append(rng.choice(prints[:10] + prints[40:]) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    found = simhash.near_duplicate_components(spark.createDataFrame(signed, "doc_id long, fingerprint long"))
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)


def test_pivots_discard_pairs_before_they_are_verified():
    from matchflow.llm import simhash as S

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = prints[:200] ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(200)], np.uint64)
    prints = np.concatenate([prints, near])
    table = S.distance_table(prints)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    met = [p for p in S.near_pairs(np.zeros(len(prints), np.int8), table[:, 0])]
    left = [S.screened(table, *p) for p in met]
    linked = {(int(a), int(b)) for p in left for a, b in zip(*S.verified(prints, *p), strict=True)}
    n_met, n_left = sum(len(i) for i, _ in met), sum(len(i) for i, _ in left)
    assert linked == {(int(a), int(b)) for a in range(len(prints)) for b in a + 1 + np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= 4)}
    assert n_met < 0.6 * len(prints) * (len(prints) - 1) / 2 and n_left < n_met / 1000 and len(linked) == 200


def test_components_of_odd_tables(spark, odd, empty):
    from matchflow.llm.simhash import near_duplicate_components

    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    want = collections.Counter((i, c) for (i, _), c in zip(rows, brute_components(rows), strict=True))
    assert collections.Counter((r.doc_id, r.component_id) for r in near_duplicate_components(odd).collect()) == want
    assert near_duplicate_components(empty).count() == 0


# 6: context-tree weighting by definition


def test_scores_equal_the_recursion(spark, monkeypatch):
    from matchflow.llm import context_tree

    monkeypatch.setattr(context_tree, "CHUNK_BYTES", 60)  # many chunks of a text or two
    monkeypatch.setattr(context_tree, "BLOCK", 40)
    monkeypatch.setattr(context_tree, "FAN", 3)  # and several rounds of sums
    texts = [t or None for t in random_texts(60, ["the ", "A", "b", "é ", "\n", "cat "], 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.model_scores(docs).collect()}
    training = [zlib.crc32(str(i).encode()) % 10 != 0 for i in range(60)]
    bodies = [b"\xff" * 5 + " ".join(words(t)).encode() + b"\xff" for t in texts]
    seen = collections.Counter((x[j - d : j], 1 << k | x[j] >> (8 - k), x[j] >> (7 - k) & 1) for x, ok in zip(bodies, training, strict=True) if ok for j in range(5, len(x)) for d in range(6) for k in range(8))
    nodes = {(c, b) for c, b, _ in seen}
    children = collections.defaultdict(list)
    for c, b in nodes:
        if c:
            children[c[1:], b].append((c, b))
    estimate = lambda c, b: math.lgamma(seen[c, b, 0] + 0.5) + math.lgamma(seen[c, b, 1] + 0.5) - math.log(math.pi) - math.lgamma(seen[c, b, 0] + seen[c, b, 1] + 1)
    pw = {}
    for c, b in sorted(nodes, key=lambda n: -len(n[0])):
        pw[c, b] = estimate(c, b) if len(c) == 5 else np.logaddexp(estimate(c, b), sum(pw[n] for n in children[c, b])) - math.log(2)

    def score(x):
        total = 0.0
        for j in range(5, len(x)):
            for k in range(8):
                b, bit, mass, p = 1 << k | x[j] >> (8 - k), x[j] >> (7 - k) & 1, 1.0, 0.0
                for d in range(6):
                    c = x[j - d : j]
                    kt = (seen[c, b, bit] + 0.5) / (seen[c, b, 0] + seen[c, b, 1] + 1)
                    if d == 5 or (x[j - d - 1 : j], b) not in nodes:
                        p += mass * kt
                        break
                    own = math.exp(estimate(c, b) - math.log(2) - pw[c, b])
                    p, mass = p + mass * own * kt, mass * (1 - own)
                total += math.log10(p)
        return total

    counts = collections.Counter(w for t, ok in zip(texts, training, strict=True) if ok for w in (*words(t), None))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r, w = got[i], (*words(t), None)
        assert r.score == pytest.approx(score(bodies[i]), abs=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not training[i], len(w), sum(counts[x] > 0 for x in w), n)


def test_windows_and_words_do_not_depend_on_the_block(monkeypatch):
    from matchflow.llm import context_tree as C

    texts = random_texts(200, ["the ", "A", "b", "é ", "\n", "cat ", "\x85 "], 12)
    raw = [t.encode() for t in texts]
    data, sizes = C.bodies(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
    want = [" ".join(words(t)).encode() + b"\xff" for t in texts]
    assert data.tobytes() == b"".join(want) and sizes.tolist() == [len(w) for w in want]
    begins = np.cumsum(sizes) - sizes
    keys = [int.from_bytes(p[j - 5 : j][::-1] + p[j : j + 1]) for w in want for p in [b"\xff" * 5 + w] for j in range(5, len(p))]
    for step in (1, 3, 50, 10**6):
        assert [k for a in range(0, len(data), step) for k in C.windows(data, begins, a, min(a + step, len(data))).tolist()] == keys
    whole = C.word_hashes(data)
    flat = [w for t in texts for w in words(t)]
    assert len(whole[0]) == len(flat) and len({*zip(flat, whole[1].tolist(), strict=True)}) == len({*flat}) == len({*whole[1].tolist()})
    C.powers.cache_clear()
    monkeypatch.setattr(C, "STEP", 5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, C.word_hashes(data), strict=True))


def test_scores_of_odd_tables(spark, odd, empty):
    from matchflow.llm.context_tree import model_scores

    got = model_scores(odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r.doc_id for r in odd.collect())
    assert all(r.score < 0 for r in got)
    assert model_scores(empty).count() == 0


# 1 and 4: held-out accuracy, odd tables


def auc(scores, truth):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    ones = truth.sum()
    return (order[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def test_toxicity_on_held_out_rows(spark, odd, empty):
    from matchflow.llm.queries import op4_toxicity
    from matchflow.llm.toxicity import fit_toxicity, score_toxicity

    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in op4_toxicity(spark, at).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    assert auc(np.array([r.score for r in rows]), np.array([labels[r.doc_id] for r in rows])) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(odd, none)
    scores = {r.doc_id: r.score for r in score_toxicity(odd, model).collect()}
    assert len(scores) == 9 and scores[2] == scores[3] and all(0 <= s <= 1 for s in scores.values())
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (9, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert score_toxicity(odd, fit_toxicity(odd, some)).count() == odd.count()
    assert score_toxicity(empty, model).count() == 0


def test_the_grammar_weighs_clauses():
    from matchflow.llm.toxicity import BASE, Lexicon, ToxicityModel, matched_clauses

    lexicon, model = Lexicon({}, {}), ToxicityModel()
    score = lambda t: model.score(matched_clauses(t, lexicon))
    assert score("You are an idiot.") > score("An idiot.") > score("Not an idiot.")
    assert score("A fine day.") == pytest.approx(1 / (1 + math.exp(-BASE)))
    assert score("An utter idiot.") > score("An idiot.") > 0.5 > score("He was called an idiot.")
    assert score("I will kill you.") > score("kill you.") > score("kill the process.")
    assert score("Critics said nothing. You idiot.") > score("Critics said you idiot.")
    # the same words, dealt to other clauses: two matched clauses, or one; a target beside its insult, or elsewhere
    assert score("The idiot left. A clown came.") > score("The idiot clown left. A came.")
    assert score("You idiot. The weather is fine.") != score("You weather. The idiot is fine.")
    assert score("idiot idiot idiot") == score("idiot")


def test_spellings_follow_edit_arcs():
    from matchflow.llm.toxicity import INSULT, OTHER, Lexicon

    lexicon = Lexicon({"réeux": 0.1, "blarg": 4.0, "you": 5.0}, {"réeux": 3.0})
    kinds = {w: lexicon.word(w)[::2] for w in ("idiot", "1d1ot", "idiooot", "w0rthless", "worthles", "worthle", "blarg", "réeuxpa", "réeux")}
    assert kinds == {"idiot": (INSULT, 0), "1d1ot": (INSULT, 2), "idiooot": (INSULT, 2), "w0rthless": (INSULT, 1), "worthles": (INSULT, 1), "worthle": (INSULT, 2), "blarg": (INSULT, 0), "réeuxpa": (INSULT, 0), "réeux": (OTHER, 0)}
    for other in ("path", "worth", "wort", "lose", "stup", "idi", "food", "foot", "jer", "you", "1", "000", "iiiiiiiiii", ""):
        assert lexicon.word(other)[0] != INSULT, other


def test_the_composed_machine_equals_its_transducers_in_turn():
    from matchflow.llm import toxicity as T

    rng = random.Random(11)

    def in_turn(clause, machines):
        symbols = list(clause)
        for machine in machines:
            state = 0
            for k, symbol in enumerate(symbols):
                state, symbols[k] = machine.step(state, symbol)
        return symbols

    model = T.ToxicityModel(arcs=np.array([rng.gauss(0, 1) for _ in T.ARCS]), base=-1.5)
    for _ in range(300):
        clean, clauses = 1 - 1 / (1 + math.exp(1.5)), []
        for _ in range(rng.randint(0, 4)):
            clause = [(rng.randrange(T.STOP), rng.random(), rng.randint(0, 2)) for _ in range(rng.randint(0, 14))]
            kinds = [c[0] for c in clause]
            forth = in_turn(kinds, T.FORTH)
            back = in_turn(kinds[::-1], T.BACK)[::-1]
            found = [(a | b, odds, edits) for (kind, odds, edits), a, b in zip(clause, forth, back, strict=True) if kind in (T.INSULT, T.THREAT)]
            assert T.clause_matches(clause) == found
            if found:
                # the weights along each path, added up; the best path; any toxic clause
                paths = [model.arcs[0 if s & T.KIND == T.INSULT else 1] + sum(model.arcs[2 + k] for k, m in enumerate(T.MARKS) if s & m) + model.arcs[6] * o + model.arcs[7] * e for s, o, e in found]
                clean *= 1 - 1 / (1 + math.exp(-max(paths)))
                clauses.append(found)
        assert model.score(clauses) == pytest.approx(1 - clean)


def planted_clauses(n, seed):
    """Texts with one clause around a seed word; what the clause says makes it toxic, and every word is as common in both classes."""
    from matchflow.llm.toxicity import INSULT, SEEDS, THREAT

    rng = random.Random(seed)
    noise = lambda: " ".join(rng.choice("report covers water prices rail work towns local".split()) for _ in range(rng.randint(3, 8)))
    rows = []
    for _ in range(n):
        s, h, toxic = rng.choice(SEEDS[INSULT].split()), rng.choice(SEEDS[THREAT].split()), rng.random() < 0.5
        clause = rng.choice([f"you are a {s}", f"such an utter {s}", f"we will {h} you", f"a {s}"] if toxic else [f"you are not a {s}", f"the critic said such an utter {s}", f"never {h} you", f"quoted: he said a {s}", f"{h} a process"])
        rows.append((f"{noise()}. {noise()} {clause}. {noise()}.", int(toxic)))
    return rows


def test_without_its_transducers_the_grammar_cannot_tell_clauses(monkeypatch):
    from matchflow.llm import toxicity as T

    fit, held = planted_clauses(1500, 1), planted_clauses(800, 2)

    def held_out_auc():
        lexicon = T.Lexicon({}, {})
        told = [[(n, np.array(m)) for n, m in T.told_clauses(t, lexicon)] for t, _ in fit]
        model = T.ToxicityModel({}, {}, *T.fit_arcs(told, np.array([y for _, y in fit], float)))
        return auc(np.array([model.score(T.matched_clauses(t, lexicon)) for t, _ in held]) + 1e-12 * np.random.default_rng(0).random(len(held)), np.array([y for _, y in held]))

    whole = held_out_auc()
    monkeypatch.setattr(T, "MACHINE", T.compose(()))
    monkeypatch.setattr(T, "REVERSED", T.compose(()))
    assert whole > 0.95 and held_out_auc() < whole - 0.2


def test_arcs_are_the_likeliest():
    from matchflow.llm import toxicity as T

    fit = planted_clauses(400, 3)
    lexicon = T.Lexicon({}, {})
    told = [[(n, np.array(m)) for n, m in T.told_clauses(t, lexicon)] for t, _ in fit]
    y = np.array([t for _, t in fit], float)
    arcs, base = T.fit_arcs(told, y)
    prior = np.append(T.ARCS, T.BASE)

    def loss(w):
        p = np.array([T.ToxicityModel({}, {}, w[:-1], float(w[-1])).score(T.matched_clauses(t, lexicon)) for t, _ in fit])
        return -(y * np.log(p) + (1 - y) * np.log1p(-p)).sum() + ((w - prior) ** 2).sum() / 2

    w = np.append(arcs, base)
    best = loss(w)
    assert best < loss(prior) and all(loss(w + d) >= best - 1e-6 for k in range(len(w)) for d in (np.eye(len(w))[k] * 0.01, np.eye(len(w))[k] * -0.01))


def test_a_labelled_id_gives_one_row(spark):
    """Rows of a repeated id stay in Spark: the fit takes one of them."""
    from pyspark.sql import functions as F

    from matchflow.llm.toxicity import labelled_sample

    many = spark.range(50_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("you idiot "), "id").alias("text"))
    docs = many.unionByName(spark.createDataFrame([(k, "a fine day") for k in range(2, 400)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, 1, int(k == 1)) for k in range(1, 400)] + [(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    fit = {k for k in range(1, 400) if zlib.crc32(str(k).encode()) % 5}
    rows = labelled_sample(docs, labels).collect()
    assert {r.doc_id for r in rows} == fit and len(rows) == len(fit) and {r.toxic for r in rows if r.doc_id == 1} == ({1} if 1 in fit else set())
    assert 0 < labelled_sample(docs, labels, 50).count() < 90


def test_quality_of_held_out_labels(spark):
    from matchflow.llm.quality import quality_scores

    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    kept_back = "crc32(cast(doc_id as string)) % 5 = 0"
    truth = {r.doc_id: r.quality for r in labels.filter(kept_back).collect()}
    rows = [r for r in quality_scores(docs, labels.filter(f"not ({kept_back})")).filter(kept_back).collect() if r.doc_id in truth]
    for column, least in (("score", 0.99), ("content_score", 0.99), ("metadata_score", 0.55)):
        assert auc(np.array([r[column] for r in rows]), np.array([truth[r.doc_id] for r in rows])) > least


def test_an_exchange_gives_the_surest_rows_in_the_classes_shares(spark):
    from matchflow.llm import quality

    rng = random.Random(4)
    rows = [(i, rng.gauss(1, 4)) for i in range(5000)]
    share = 0.7
    got = {r.doc_id: r.y for r in quality.sure_ones(spark.createDataFrame(rows, "doc_id long, logit double"), "logit", share).collect()}
    order = sorted(rows, key=lambda r: r[1])
    least = math.log(quality.SURE / (1 - quality.SURE))
    good = [i for i, x in order[-round(5000 * quality.SHARE * share) - 10 :] if x >= least]
    bad = [i for i, x in order[: round(5000 * quality.SHARE * (1 - share)) + 10] if x <= -least]
    ones, zeros = {i for i, y in got.items() if y == 1}, {i for i, y in got.items() if y == 0}
    assert ones <= {*good} and zeros <= {*bad} and len(zeros) > 100
    assert len(ones) / len(got) == pytest.approx(share, abs=0.03)
    # nothing that one class is sure of, nothing given
    assert quality.sure_ones(spark.createDataFrame([(i, 5.0) for i in range(50)], "doc_id long, logit double"), "logit", share).count() == 0


def test_an_exchange_helps_a_view_with_few_labels(spark):
    """Sources tell quality at once, words only after many documents: pseudo-labels of the metadata view teach the content view."""
    from matchflow.llm.quality import quality_scores

    rng = random.Random(12)
    good, bad = ([f"{a}{k}" for k in range(60)] for a in ("fine", "poor"))
    rows, labels = [], []
    for i in range(3000):
        y = i % 2
        words_ = [rng.choice(good if (rng.random() < 0.5 + (0.12 if y else -0.12)) else bad) for _ in range(40)]
        rows.append((i, " ".join(words_), "en", f"s{y if rng.random() < 0.97 else 1 - y}", 200))
        if i < 200:
            labels.append((i, y, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def content_auc(rounds):
        found = [r for r in quality_scores(docs, known, rounds=rounds).collect() if r.doc_id >= 200]
        return auc(np.array([r.content_score for r in found]), np.array([r.doc_id % 2 for r in found]))

    alone, taught = content_auc(0), content_auc(3)
    print(alone, taught)
    assert taught > alone + 0.03


def test_quality_on_labelled_rows(spark, odd, empty):
    from matchflow.llm.queries import op1_quality
    from matchflow.llm.quality import quality_scores

    at = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = [r for r in op1_quality(spark, at).collect() if r.doc_id in labels]
    assert auc(np.array([r.score for r in rows]), np.array([labels[r.doc_id] for r in rows])) > 0.95
    schema = "doc_id long, quality int, toxic int"
    for given in ([], [(1, 1, 0)], [(1, 1, 0), (3, 0, 0), (9, 0, 1), (8, 1, 0), (1, None, 1), (None, 1, 1)]):
        got = quality_scores(odd, spark.createDataFrame(given, schema)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    assert quality_scores(empty, spark.createDataFrame([(1, 1, 0), (3, 0, 0)], schema)).count() == 0


# all: ids that floats cannot tell apart, beside a null


def test_large_ids_beside_nulls(spark, tmp_path, sf_dir):
    import corpus_pipeline
    from matchflow.llm import context_tree, decontamination, merkle, pieces, quality, secret_scan, simhash, stages, token_counts, toxicity, warc

    big = 2**53 + 1
    rows = [(big, "the quick brown fox", "en", "a", big), (None, "password=abcdef123456789", "en", "a", None), (big + 2, "a lazy dog sleeps", "en", "b", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(big, 1, 0), (big + 2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(big, "quick brown fox"), (big + 2, "lazy dog"), (None, "x")], "item_id long, text string")
    want = {None, big, big + 2}
    model = toxicity.fit_toxicity(docs, labels)
    leaks = decontamination.find_leaks(docs, bench).collect()
    assert {(r.doc_id, x.item_id) for r in leaks for x in r.leaks} == {(big, big), (big + 2, big + 2)}
    components = simhash.near_duplicate_components(docs).collect()
    assert {(r.doc_id, r.component_id) for r in components} == {(i, i) for i in want}
    for found in (
        leaks,
        components,
        quality.quality_scores(docs, labels).collect(),
        quality.views(docs).collect(),
        toxicity.score_toxicity(docs, model).collect(),
        token_counts.count_tokens(docs, BYTE_BPE).collect(),
        context_tree.model_scores(docs).collect(),
        secret_scan.find_secrets(docs).collect(),
        merkle.document_fingerprints(docs).collect(),
        pieces.pieces_round_trip(docs, PIECE_BPE).collect(),
        pieces.decode_pieces(pieces.encode_pieces(docs, PIECE_BPE, keep=("n_chars",)), PIECE_BPE).collect(),
    ):
        assert {r.doc_id for r in found} == want and len(found) == 3
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    warc.write_warc(pages, f"file://{tmp_path}/w")
    assert {r.record_id for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()} == {f"<urn:page:{'' if i is None else i}>" for i in want}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).collect()
        assert {(r.doc_id, r.n_chars) for r in kept} <= {(big, big), (None, None), (None, 8), (big + 2, 17)} and len(kept) >= 2
    assert {r.doc_id for r in stages.encode_and_decode(spark, docs, sf_dir).collect()} == want


def test_near_dedup_keeps_one_row_of_repeated_ids(spark, odd, sf_dir):
    from matchflow.llm.stages import keep_one_of_each_group

    rows = [(5, "b", "en", "a", 1), (5, "b", "en", "a", 1), (5, "b", "de", "a", 1), (6, "b", "en", "a", 1), (7, "other words here", "en", "a", 1), (None, "b", "en", "a", 1)]
    kept = keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir).collect()
    assert sorted((r.doc_id or 0, r.lang) for r in kept) == [(0, "en"), (5, "de"), (7, "en")]


def test_words_of_any_length_are_counted():
    from tokenizers import Tokenizer

    from matchflow.llm import token_counts

    library = Tokenizer.from_file(BYTE_BPE)
    machine = token_counts.compiled(BYTE_BPE)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(5000))
    kept, token_counts.KEPT_STATES = token_counts.KEPT_STATES, 800
    try:
        assert machine.counts([long, long[::-1]]).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in (long, long[::-1])]
    finally:
        token_counts.KEPT_STATES = kept
