"""Repeated bytes, lines and whole texts, and near copies, against plain Python over the smallest tables and odd rows."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyload.llm import exact_dedup, mixing, simhash, substring_dedup, suffix_dedup, suffix_order
from skyload.llm.queries import ORACLES, QUERIES

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def removed_bytes(texts, length=100):
    """(n_bytes, ranges, kept) per text in order: every window looked up in a set of the windows before."""
    seen, out = set(), []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            window = text[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            else:
                seen.add(window)
        steps = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        ranges = list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()))
        out.append((len(text), ranges, bytes(np.frombuffer(text, np.uint8)[~gone])))
    return out


def test_repeated_bytes_of_documents(spark, folder, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op7_suffix_array_dedup"](spark, folder).collect()}
    expected = removed_bytes([(text or "").encode() for _, text, *_ in documents])
    assert sum(len(ranges) for _, ranges, _ in expected) > 20
    for (doc_id, *_), (size, ranges, kept) in zip(documents, expected):
        r = rows[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (size, sum(b - a for a, b in ranges), len(ranges)), doc_id
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def made_texts():
    draw = np.random.default_rng(8)
    words = ["ab", "cde", "é", "fghij", "k", "ß", "lmn"]
    text = lambda n: " ".join(draw.choice(words, n))
    shared, common = text(60), text(41)
    out = [text(80) + shared + text(50), shared + text(70), text(30) + common + text(30) + common, "a" * 900, "ab" * 400 + "a" * 150, "", "x" * 99, "x" * 100, "x" * 101]
    out += [text(10) + common + text(int(draw.integers(0, 60))) for _ in range(40)] + [out[0], out[0][:200] + "Z" + out[0][200:]] + ["q" * 300 + common] * 3
    return out


@pytest.mark.parametrize("block, shard", [(1 << 18, 1 << 20), (700, 300)])
def test_repeated_bytes_in_small_parts(spark, monkeypatch, block, shard):
    """Also where texts are cut into blocks and one key fills several shards; blocks and shards must not change a result."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    texts = made_texts()
    encoded = [text.encode() for text in texts]
    # The steps of the job, without Spark, so that the sizes above hold in them.
    batches = list(suffix_dedup.cut_texts(list(enumerate(encoded))))
    rows = sorted({tuple(r.values()) for b in batches for r in b.to_pylist()})
    import pyarrow as pa

    def as_batches(rows, schema, size):
        return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), schema.types)], schema=schema) for i in range(0, len(rows), size)]

    sifted = [tuple(r.values()) for b in suffix_dedup.sift(iter(as_batches(rows, suffix_dedup.ARROW_FRAGMENTS, 7))) for r in b.to_pylist()]
    parts = sorted((key, doc, start, encoded[doc][start : start + number + 99]) for key, doc, start, number in sifted if key is not None)
    spans = defaultdict(list)
    for key, doc, start, number in sifted:
        if key is None:
            spans[doc].append({"start": start, "number": number})
    for b in suffix_dedup.sort_shards(iter(as_batches(parts, suffix_dedup.ARROW_PARTS, 5))):
        for r in b.to_pylist():
            spans[r["doc"]].append({"start": r["start"], "number": r["number"]})
    for doc, (_, ranges, kept) in enumerate(removed_bytes(encoded)):
        assert suffix_dedup.cut_out(encoded[doc], spans[doc]) == (ranges, kept), doc


def test_suffix_order():
    draw = np.random.default_rng(1)
    samples = [draw.integers(0, draw.integers(1, 6), draw.integers(1, 400)).astype(np.uint8) for _ in range(40)]
    samples += [np.frombuffer(t, np.uint8) for t in (b"a" * 300, b"ab" * 150, bytes(range(256)) * 2, b"x", b"\0" * 50 + b"\xff" * 50, b"the quick fox and " * 30)]
    for text in samples:
        for depth in (5, 100):
            order, raw = suffix_order.suffix_array(text, depth), text.tobytes()
            assert sorted(order.tolist()) == list(range(len(raw)))
            found = [raw[i : i + depth] for i in order]
            assert found == sorted(found)
            shared = suffix_order.common_prefixes(text, order)
            for a, b in zip(order[:-1], order[1:]):
                size = 0
                while max(a, b) + size < len(raw) and raw[a + size] == raw[b + size]:
                    size += 1
                assert shared[b] == size


def test_repeated_bytes_of_odd_rows(spark, odd, nothing):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == 13 and suffix_dedup.remove_repeats(nothing).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[7]["n_removed"] == 55 * 4000 - 55 - 100 + 1 + 54 or by_id[7]["n_removed"] > 55 * 3990
    assert by_id[1]["n_removed"] == by_id[2]["n_removed"] == 0 and by_id[3]["n_bytes"] == 0
    twice = spark.createDataFrame([(1, "z" * 40 + "y" * 90), (1, "z" * 40 + "y" * 90), (1, "w" + "z" * 40 + "y" * 90), (None, "y" * 100)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(twice).collect())
    # The two equal rows are one text; of the two texts with id 1 one holds all the other has.
    assert len(found) == 4 and found[0] == (0, 100, 0) and found[1][2] == found[2][2]
    assert {found[1][2] > 0, found[3][2] > 0} == {True, False}


def run_sql(folder, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    answer = connection.execute(ORACLES[name])
    columns = [column[0] for column in answer.description]
    return [dict(zip(columns, row)) for row in answer.fetchall()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    expected = run_sql(folder, name)
    found = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
    assert found and sorted(found, key=str) and sorted(map(lambda r: sorted(r.items()), found)) == sorted(map(lambda r: sorted(r.items()), expected))


def test_exact_classes(spark, odd, nothing):
    rows = exact_dedup.exact_classes(odd).collect()
    assert len(rows) == 13 and exact_dedup.exact_classes(nothing).count() == 0
    classes = defaultdict(list)
    for r, (doc_id, text) in zip(sorted(rows, key=str), sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=str)):
        classes[r["text_sha256"]].append(r)
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    for r in rows:
        same = [(len(t), d) for d, t in texts if hashlib.sha256(t.translate(WHITE).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == min(same, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[1]
    # A digest that takes all texts for copies: the bytes still keep them apart.
    weak = exact_dedup.exact_classes(odd, digest=lambda text: F.when(text.isNotNull(), "same")).collect()
    assert sorted((r["text_sha256"], r["group_size"]) for r in weak) == sorted((r["text_sha256"], r["group_size"]) for r in rows)
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["text_sha256"] for r in rows})


def test_lines(spark, odd, nothing):
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == 13 and substring_dedup.remove_repeats(nothing).count() == 0
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [r["n_removed"] for r in by_id[7]] == [3999] and [r["n_removed"] for r in by_id[6]] == [2] and [r["n_removed"] for r in by_id[3]] == [0]
    assert [r["passage_chars"] for r in by_id[7]] == [3999 * 55 - 1] and [r["n_removed"] for r in by_id[-5]] == [0]
    docs = spark.createDataFrame([(1, "One  two three four FIVE\nkeep me\n\nx"), (2, "a\none two three four five\nb"), (3, "p q r s t\nu\n\np q r s t\nu")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert found[2]["kept_text"] == "a\n\nb" and [(c["start"], c["end"], c["first_id"]) for c in found[2]["removed"]] == [(2, 25, 1)]
    assert found[3]["kept_text"] == "p q r s t\nu\n\n\n"
    paragraphs = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, unit="paragraph").collect()}
    assert paragraphs[3]["kept_text"] == "p q r s t\nu\n\n" and paragraphs[2]["n_removed"] == 0


def test_sentences_of_long_lines(spark):
    inner = "".join(f"This is sentence number {n} of the copied passage. " for n in range(8)) + "Yes. " + "所有权利保留，未经书面许可不得以任何方式复制或转载本页内容。"
    texts = {"a": "Some words ahead. " + inner + " And the end of a line that nobody else has.", "b": "Quite another start that is long enough to count, " + inner + "no end", "c": "今天天气很好", "d": "今天天气很好"}
    docs = spark.createDataFrame([(k, v, {"a": 1}, "u", 1) for k, v in texts.items()], "doc_id string, text string, removed map<string,int>, unit string, start int")
    for table in (docs, docs.select(F.encode("doc_id", "utf-8").alias("doc_id"), "text")):
        found = {r["doc_id"] if isinstance(r["doc_id"], str) else bytes(r["doc_id"]).decode(): r for r in substring_dedup.remove_repeats(table).collect()}
        assert found["a"]["n_removed"] == 0 and found["c"]["kept_text"] == texts["c"] and found["d"]["kept_text"] == "" and found["d"]["passage_chars"] == 0
        first = "This is sentence number 0 of the copied passage. "  # stays with the words before it, which are too short to end a part in a but not in b
        assert found["b"]["kept_text"] == "Quite another start that is long enough to count, " + first + "no end"
        assert found["b"]["passage_chars"] == len(inner) - len(first) and found["b"]["n_removed"] == 8


def plain_print(text, shingle=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(prints, distance):
    """Smallest id per component, by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, folder, documents):
    prints = {d: plain_print(t or "") for d, t, *_ in documents}
    expected = linked(prints, 2)
    rows = QUERIES["op8_simhash_near_dedup"](spark, folder).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{p:016x}", expected[d]) for d, p in prints.items()}
    assert len(set(expected.values())) < len(expected)


@pytest.mark.parametrize("distance", [1, 2])
def test_links_of_made_fingerprints(spark, distance):
    """Long chains, stars and neighbours just too far away."""
    draw = np.random.default_rng(distance)
    values = []
    for _ in range(12):
        value = int(draw.integers(0, 1 << 63)) * 2 + int(draw.integers(0, 2))
        values.append(value)
        for _ in range(int(draw.integers(1, 25))):
            for bit in draw.choice(64, int(draw.integers(1, 4)), replace=False):
                value ^= 1 << int(bit)
            values.append(value)
    values += [0, 3, (1 << 64) - 1, (1 << 64) - 2]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["fp"]: r["root"] for r in simhash.fingerprint_classes(prints, distance).collect()}
    groups = linked({s: v for s, v in zip(signed, values)}, distance)
    sizes = defaultdict(int)
    for root in groups.values():
        sizes[root] += 1
    assert found == {v: root for v, root in groups.items() if sizes[root] > 1}


def test_near_copies_of_odd_rows(spark, odd, nothing):
    rows = simhash.near_classes(odd).collect()
    assert len(rows) == 13 and simhash.near_classes(nothing).count() == 0
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["component_id"] for r in rows})


def test_near_copies_with_shared_ids(spark):
    """Rows that share an id, or have none, but no component: every component keeps one row, by id, then by hash of the text."""
    texts = [" ".join(f"{name}{i}" for i in range(40)) for name in "abcde"]
    a, b, c, d, e = texts
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d.upper()), (None, d + " "), (9, e), (9, e + "\n"), (7, c)]
    docs = spark.createDataFrame([(*row, n % 2) for n, row in enumerate(rows)], "doc_id long, text string, side int")
    kept = simhash.drop_near_copies(docs)
    least = min((e, e + "\n"), key=lambda text: hashlib.sha256(text.encode()).digest())
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (9, least)], key=str)


def test_map_columns_text_ids_and_clashing_names(spark):
    """Rows that repeat, with columns that have no order or the names of helpers."""
    text = "alpha beta gamma delta epsilon zeta"
    rows = [("a", text, {"k": 1}, "s", 7, 1), ("a", text, {"k": 1}, "s", 7, 1), ("a", text, {"k": 2}, "s", 8, 1), ("b", "quite other words stand here", {}, None, 9, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, facts map<string,int>, source string, epoch_ int, times int")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["times"]) for r in kept.collect()) == [("a", 1), ("b", 2)]
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns and {r["epoch_"] for r in drawn.collect()} <= {7, 8, 9}
    assert substring_dedup.remove_repeats(docs).count() == 4
