"""Token alignment, resampling and WARC archives against brute force, on small and awkward inputs."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailwarden.llm import resampling, token_align, warc
from trailwarden.llm.common import table
from trailwarden.llm.packing import vocabulary_path

SF = "/root/testdata/sf0.001"
ODD = [
    "plain words stand here", None, "", " leads with a space", "two  spaces and more   of them", "ends with one ", "a\n\nb \n c\td\r\n",
    "äöü ßß 东京 🙂🙂 café", "<|endoftext|> and <s> are text", "it's we'll 1234567 $%&/ x86", "nul\x00byte and\x85next line",
    "é combining ẛ̣ ﬁne   separators", " ", "\n", "▁ the mark itself ▁▁x", "hello hello hello hello",
    "word " * 3000 + "end", "x" * 4000,
]


@pytest.fixture(scope="module")
def aligner():
    return token_align.Aligner(vocabulary_path(token_align.BYTE_VOCABULARY), vocabulary_path(token_align.PIECE_VOCABULARY))


def brute_alignment(aligner, texts):
    """Rows after doc_id, from whole texts and every pair of neighbouring ranges."""
    found, counts = [], collections.Counter()
    for text in texts:
        raw = f" {text}".encode()
        a = aligner.byte_level.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = aligner.pieces.encode(text) if text else []
        sides = [[aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]]
        if not text or any(b"".join(s) != raw for s in sides):
            found.append((0, 0, 0, [], ""))
            continue
        (a_ends, b_ends) = (np.cumsum([len(x) for x in s]).tolist() for s in sides)
        groups, i, j = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            p, q = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        links, k = [], 0
        for i, end in enumerate(a_ends):
            start = a_ends[i - 1] if i else 0
            while b_ends[k] <= start:
                k += 1
            m = k
            while m < len(b) and (b_ends[m - 1] if m else 0) < end:
                links.append((a[i], b[m]))
                m += 1
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (n_a, n_b, n_g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "", g or "")
        for n_a, n_b, n_g, ls, g in found
    ]


def test_alignment_of_the_tables(spark, aligner):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = {i: w[:7] for (i, _), w in zip(rows, brute_alignment(aligner, [t for _, t in rows]))}
    got = token_align.op11_token_align(spark, SF).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_alignment_of_odd_texts(spark, aligner):
    texts = [*ODD, "repeated row", "repeated row"]
    docs = spark.createDataFrame([(None if t == "x" * 4000 else k, t, 1, "s") for k, t in enumerate(texts)], "doc_id long, text string, block int, links string")
    got = token_align.align_documents(docs, with_groups=True).collect()
    want = brute_alignment(aligner, texts)
    assert collections.Counter(tuple(r)[1:8] for r in got) == collections.Counter(w[:7] for w in want)
    spelt = {r.doc_id: r.groups for r in got}
    assert all(spelt[k] == w[7] for k, w in enumerate(want) if k in spelt)
    assert want[8][0] > 8 and want[10][0] > 0  # special strings and control characters are text


def test_links_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "hello hello"), (2, "hello")], "doc_id long, text string")
    links = token_align.link_counts(token_align.token_blocks(docs)).collect()
    assert sum(r.n for r in links) == sum(r.n_links for r in token_align.align_documents(docs).collect())
    assert all(r.links == r.a_id * token_align.RADIX + r.b_id for r in links)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=60))
def test_skipping_finds_all_common_ends(flags):
    a = [k for k, (x, _) in enumerate(flags) if x] + [len(flags)]
    b = [k for k, (_, y) in enumerate(flags) if y] + [len(flags)]
    groups, stretches = token_align.align_ends(a, b)
    ends = [a[past - 1] for _, past, _, _ in groups] + [a[i + k] for i, _, run in stretches for k in range(run)]
    assert sorted(ends) == sorted(set(a) & set(b))
    assert all(a[i + k] == b[j + k] for i, j, run in stretches for k in range(run))
    assert all(len(range(i, p)) + len(range(j, q)) > 2 for i, p, j, q in groups)


def test_a_block_is_small():
    """What a task holds at once is one row of some 2 MB of text, whatever the size of a batch."""
    texts = [" ".join(f"w{(7 * i + k) % 997}" for k in range(20_000)) for i in range(60)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(60), "text": texts})
    docs = []
    for row in token_align._blocks([batch], token_align.BYTE_VOCABULARY, token_align.PIECE_VOCABULARY, False):
        docs += (ids := row.column("doc_ids")[0].as_py())
        size = sum(len(texts[i]) for i in ids)
        assert size <= 2 << 20 and row.nbytes < 0.6 * size
    assert docs == list(range(60))


@pytest.mark.parametrize("most", [0, 1, 255, 256, 65_535, 65_536, 1 << 33])
def test_packed_numbers(most):
    values = np.array([0, most // 2, most])
    assert token_align._unpacked(token_align._packed(values)).tolist() == values.tolist()
    assert token_align._unpacked(token_align._packed(values[:0])).tolist() == []


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.align_documents(docs).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, token_align.align_documents(blank).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_features_without_spelling_them():
    texts = [*ODD, "y" * 600 + " z " + "ß" * 300]
    owner, bucket, words = resampling.features(pa.array(texts))
    got = collections.defaultdict(collections.Counter)
    for o, b in zip(owner.tolist(), bucket.tolist()):
        got[o][b] += 1
    for k, t in enumerate(texts):
        want_words, want = brute_features(t)
        assert words[k] == len(want_words) and got[k] == collections.Counter(want)


def test_sliced_weights_equal_plain_sums():
    rng = np.random.default_rng(5)
    gain = rng.integers(-9000, 9000, 10_000)
    owner = np.sort(rng.integers(0, 700, 40_000))
    bucket = np.where(rng.random(40_000) < 0.3, 77, rng.integers(0, 10_000, 40_000))  # one bucket repeats much
    got = resampling.sliced_weights(owner, bucket, 700, resampling.gain_planes(gain), 10_000)
    assert got.tolist() == np.bincount(owner, gain[bucket], minlength=700).astype(int).tolist()
    zero = np.zeros(10_000, int)
    assert not resampling.sliced_weights(owner, bucket, 700, resampling.gain_planes(zero), 10_000).any()


def test_resampling_of_odd_rows(spark):
    texts = [*ODD, *(f"common words of row {k} " * 8 for k in range(40))]
    rows = [(k if k % 9 else None, t, -1) for k, t in enumerate(texts)] + [(5, texts[30], -1), (5, texts[30], -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    target = spark.createDataFrame([(1, "common words of row 3"), (2, None)], "item_id long, text string")
    got = resampling.resample(docs, target).collect()
    bags = [brute_features(t) for _, t, _ in rows]
    s = collections.Counter(b for _, f in bags for b in f)
    t = collections.Counter(brute_features("common words of row 3")[1])
    total, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted))) for b in range(10_000)]
    want = []
    for (i, _, _), (words, f) in zip(rows, bags):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= 20])
    want.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0]))
    drawn = sum(r[4] for r in want) * 5 // 100
    assert drawn
    want = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(want)]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, shard string")


BIG = "<p>" + "same text " * 30 + "</p>"
PAGES = [
    (3, "http://a/3", BIG, 1, ""), (1, "http://a/1", BIG, 1, ""), (2, None, BIG, 1, ""), (4, "http://a/ü\r\nX: y", "<p>é🙂</p>", 1, ""),
    (5, "u", "<p>é🙂</p>", 1, ""), (6, "u", None, 1, ""), (7, "u", "", 1, ""), (None, "n", BIG, 1, ""), (None, None, "only here " * 20, 1, ""),
    (8, "u", "x" * 99, 1, ""), (9, "u", "x" * 99, 1, ""), (10, "u", "y" * 100, 1, ""), (11, "u", "y" * 100, 1, ""), (11, "u", "y" * 100, 1, ""),
    (12, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 9, 1, ""), (-4, "u", "\x00\x01" * 90, 1, ""), (13, "u", "long " * 300_000, 1, ""),
]


def brute_records(rows):
    body = lambda h: (h or "").encode()
    least = {}
    for i, _, h, *_ in rows:
        if len(body(h)) >= 100 and i is not None:
            least[body(h)] = min(i, least.get(body(h), i))
    out = []
    for i, _, h, *_ in rows:
        owner = least.get(body(h))
        other = owner is not None and owner != i
        out.append((i, len(body(h)), hashlib.sha256(body(h)).hexdigest(), "revisit" if other else "response", owner if other else None))
    return collections.Counter(out)


def contents(root):
    return {p.name: p.read_bytes() for p in Path(root).glob("*.warc.gz")}


def test_archive_round_trip(spark, tmp_path):
    pages = pages_of(spark, PAGES)
    roots = [str(tmp_path / n) for n in ("one", "two")]
    for root, parts in zip(roots, (1, 7)):
        warc.write_archive(pages.repartition(parts), root, shard_bytes=3000, file_bytes=700)
    files = contents(roots[0])
    assert len(files) > 5 and files == contents(roots[1])  # byte for byte, however the input is dealt
    assert not list(Path(roots[0]).glob("_temporary/*"))
    back = warc.read_archive(spark, roots[0]).collect()
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(r[k] for k in keys) for r in back) == brute_records(PAGES)
    by_id = {r.page_id: r for r in back}
    assert bytes(by_id[4].payload).decode() == "<p>é🙂</p>" and by_id[4].url == "http://a/ü%0D%0AX: y"
    assert by_id[2].payload is None and by_id[2].url is None and by_id[2].refers_to == 1
    # ids ascend through the files in order of their names, and each member can be read alone
    order = [r.page_id for r in sorted(back, key=lambda r: (r.file, r.offset))]
    known = [i for i in order if i is not None]
    assert known == sorted(known) and order[-2:] == [None, None]
    manifest = spark.read.parquet(f"{roots[0]}/manifest").collect()
    assert sum(r.records for r in manifest) == len(PAGES)
    for r in manifest:
        assert hashlib.sha256(files[r.file]).hexdigest() == r.sha256 and len(files[r.file]) == r.bytes
        assert gzip.decompress(files[r.file]).count(b"WARC-Type: ") == r.records
    one = by_id[12]
    assert warc.parse_record(next(warc._members(open(f"{roots[0]}/{one.file}", "rb")))[1] if not one.offset else dict(warc._members(open(f"{roots[0]}/{one.file}", "rb")))[one.offset])["page_id"] == 12


def test_damage_is_noticed():
    whole = warc.record_bytes(1, "u", "response", None, hashlib.sha256(b"body").hexdigest(), b"body")
    assert warc.parse_record(whole)["payload"] == b"body"
    with pytest.raises(ValueError):
        warc.parse_record(whole.replace(b"\r\n\r\nbody", b"\r\n\r\nbodx"))
    import io

    with pytest.raises(ValueError):
        list(warc._members(io.BytesIO(warc.packed(whole)[:-3])))


def test_a_failed_attempt_leaves_no_record(spark, tmp_path):
    """A task that dies after some files is repeated; what its first attempt left does not count."""
    root = str(tmp_path / "again")
    writer = warc.ShardWriter(root, 0, 10)
    list(writer.add(99, warc.packed(b"half")))  # a whole file under its final name
    writer.file_bytes = 1 << 20
    list(writer.add(98, b"unfinished"))
    warc.write_archive(pages_of(spark, PAGES[:3]), root)
    back = warc.read_archive(spark, root).collect()
    assert sorted(r.page_id for r in back) == [1, 2, 3]


def test_archive_of_nothing(spark):
    root = warc.write_archive(pages_of(spark, []))
    assert warc.read_archive(spark, root).collect() == []


def test_bounds_are_reached_by_binary_search(spark):
    ids = [None, -5, 0, 3, 4, 5, 9, 10, 11]
    frame = spark.createDataFrame([(i,) for i in ids], "page_id long")
    for bounds in ([], [4], [0, 5, 10], [-5, 0, 3, 4, 9]):
        got = {r[0]: r[1] for r in frame.select("page_id", warc.shard_of(frame.page_id, bounds)).collect()}
        assert got == {i: sum(b <= (warc.LAST_ID if i is None else i) for b in bounds) for i in ids}


def test_packing_tokenizes_a_bounded_part_of_a_batch_at_a_time(monkeypatch):
    from trailwarden.llm import packing

    seen, encode = [], packing.WordEncoder.encode

    def watched(self, texts):
        seen.append(sum(len(t) for t in texts.to_pylist()))
        return encode(self, texts)

    monkeypatch.setattr(packing.WordEncoder, "encode", watched)
    text = "some plain words and more " * 4_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": [text] * 60})
    cut = pa.Table.from_batches(packing._cut([batch], packing.VOCABULARY, 2048, False))
    assert len(seen) > 1 and max(seen) <= 2 << 20
    assert cut.column("doc_id").unique().to_pylist() == list(range(60))
    assert len(set(zip(cut.column("piece").to_pylist(), cut.column("ids_crc32").to_pylist()))) == cut.num_rows // 60
