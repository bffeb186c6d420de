"""URL filter, centroid clustering and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from skyload.llm import centroids, prefix_trie, radix_tree, url_filter
from skyload.llm.queries import ORACLES, QUERIES, URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def connection(folder):
    found = duckdb.connect()
    for name in ("embeddings", "conversations", "pages"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


# Centroid clustering


def lloyd(rows, clusters=8, rounds=10):
    """(vec_id, cluster, distance) of every row by comparing it with every centroid."""
    vectors = [[math.floor(1024 * x) for x in vector] for _, vector in rows]
    order = sorted(range(len(rows)), key=lambda n: (hashlib.sha256(f"3:{'null' if rows[n][0] is None else rows[n][0]}".encode()).hexdigest(), vectors[n]))
    middle = [vectors[n] for n in order[:clusters]]

    def nearest(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, c)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for vector in vectors:
            groups[nearest(vector)[1]].append(vector)
        middle = [[sum(column) // len(groups[k]) for column in zip(*groups[k])] if groups[k] else c for k, c in enumerate(middle)]
    return [(vec_id, *reversed(nearest(vector))) for (vec_id, _), vector in zip(rows, vectors)], middle


def test_nearest_is_exact_with_ties():
    draw = np.random.default_rng(5)
    for spread, size in ((3, 4), (2, 1), (1000, 64), (10**8, 64)):
        middle = draw.integers(-spread, spread + 1, (9, size))
        middle[4] = middle[2]
        vectors = np.concatenate([draw.integers(-spread, spread + 1, (300, size)), middle, np.zeros((2, size), np.int64)])
        number, distance = centroids.Centroids(middle.tolist()).nearest(vectors)
        full = ((vectors[:, None, :] - middle[None]) ** 2).sum(axis=2)
        assert (distance == full.min(axis=1)).all() and (number == full.argmin(axis=1)).all()


def test_search_measures_few_centroids(monkeypatch):
    draw = np.random.default_rng(6)
    middle = draw.normal(0, 30, (64, 64)) + draw.normal(0, 200, (64, 1))
    vectors = (middle[draw.integers(0, 64, 2000)] + draw.normal(0, 5, (2000, 64))).astype(np.int64)
    measured = []
    original = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: measured.append(len(a)) or original(how, a, b))
    centroids.Centroids(middle.astype(np.int64).tolist()).nearest(vectors)
    assert sum(measured) < 2000 * 64 / 8


def test_clusters(spark, folder, connection):
    rows = connection.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    expected, middle = lloyd(rows)
    found = QUERIES["op12_centroid_clustering"](spark, folder).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found) == sorted(expected)
    inertia = Counter()
    for _, cluster, distance in expected:
        inertia[cluster] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    assert all(r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values()) and r["centroid_sha256"] == digest[r["cluster"]] for r in found)
    columns = connection.execute(ORACLES["op12_centroid_clustering"])
    names = [column[0] for column in columns.description]
    assert sorted(map(tuple, columns.fetchall())) == sorted(tuple(r[name] for name in names) for r in found)


def test_odd_vectors(spark):
    one = [0.5, -0.25, 0.0, 1.0]
    rows = [
        (1, one, "c", 1.0), (1, one, "c", 1.0), (None, [1.0, 1.0, 1.0, 1.0], None, None), (2, None, "c", 1.0), (3, [], "c", 1.0), (4, [1.0, 2.0, 3.0], "c", 1.0),
        (5, [1.0, None, 2.0, 3.0], "c", 1.0), (6, [1.0, float("nan"), 2.0, 3.0], "c", 1.0), (7, [1.0, float("inf"), 2.0, 3.0], "c", 1.0),
        (8, [-0.0, 1e-9, -1e-9, 0.0], "c", 1.0), (9, one, "c", 1.0), (10, [-3.0, -2.0, -1.0, -1.5], "c", 1.0),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance double")
    whole = [(i, v) for i, v, *_ in rows if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    for clusters in (1, 3, 8):
        found = centroids.cluster_vectors(table, clusters=clusters, size=4).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=str) == sorted(lloyd(whole, clusters)[0], key=str)
    assert centroids.cluster_vectors(table.where("false"), size=4).collect() == []
    most = centroids.limit(4)
    huge = spark.createDataFrame([("a", [3e38] * 4), ("b", [-3e38] * 4), ("c", [1e300] * 4), ("d", [-1e308] * 4)], "vec_id string, embedding array<double>")
    found = {r["vec_id"]: r for r in centroids.cluster_vectors(huge, clusters=1, rounds=0, size=4).collect()}
    assert {r["distance"] for r in found.values()} == {0, 4 * (2 * most) ** 2} and found["a"]["inertia"] == centroids.MOST


# Prefix trie


def trie(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            convs[conv_id].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {conv_id: [(role, text) for *_, role, text in sorted(turns)] for conv_id, turns in convs.items()}
    built = {}
    for conv_id, turns in convs.items():
        h = zlib.crc32(str(conv_id).encode()) % 4
        built[conv_id] = tuple(convs.get(conv_id - int(math.fmod(conv_id, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv_id, turns in built.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv_id)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, own in members.items():
        for depth in range(len(path) + 1):
            leaves[path[:depth]] += not children[path]
            saved[path[:depth]] += (len(own) - 1) * len(WORD.findall(path[-1][1])) if path else 0
    return sorted(
        (
            min(own), len(path), min(members[path[:-1]]) if path else -1, len(own), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(own) if len(built[c]) == len(path)).encode()).hexdigest(),
        )
        for path, own in members.items()
    )


def nodes(df):
    return sorted(tuple(-1 if value is None else value for value in row) for row in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_radix_tree(seed):
    draw = random.Random(seed)
    width = [1, 2, 3, 16][seed]
    keys = [b"".join(draw.randbytes(width) if draw.random() < 0.6 else b"\0" * width for _ in range(draw.randint(0, 4))) for _ in range(3000)]
    tree = radix_tree.Tree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    order = tree.downward()
    held = {node.key[: node.bottom]: node.values for node, _ in order if node.values}
    expected = defaultdict(list)
    for number, key in enumerate(keys):
        expected[key].append(number)
    assert held == expected
    for node, parent in order[1:]:
        assert node.top == parent.bottom < node.bottom and (node.values or len(list(node.branches.items())) > 1)
    kinds = {type(node.branches).__name__ for node, _ in order}
    assert kinds >= {"Sorted", "Full"}
    for key in keys[:200]:
        assert all(node.key[:depth] == key[:depth] for depth in range(len(key) + 1) for node in [tree.reach(key, depth)])


def test_layouts_grow():
    tree, seen = radix_tree.Tree(), {}
    signs = list(range(256))
    random.Random(3).shuffle(signs)
    for number, sign in enumerate(signs, 1):
        tree.insert(bytes([sign]), sign)
        seen[number] = (type(tree.root.branches).__name__, getattr(tree.root.branches, "most", 0))
        assert sorted(found for found, _ in tree.root.branches.items()) == sorted(signs[:number])
    assert seen[4] == ("Sorted", 4) and seen[5] == seen[16] == ("Sorted", 16)
    assert seen[17] == seen[48] == ("Indexed", 0) and seen[49] == ("Full", 0)


def test_trie(spark, folder, connection):
    rows = connection.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found = QUERIES["op13_prefix_trie"](spark, folder)
    assert nodes(found) == trie(rows)
    columns = connection.execute(ORACLES["op13_prefix_trie"])
    names = [column[0] for column in columns.description]
    assert sorted(tuple(-1 if v is None else v for v in row) for row in columns.fetchall()) == nodes(found.select(*names))


def test_long_and_odd_conversations(spark):
    draw = random.Random(8)
    rows = []
    for conv_id in [*range(-45, 60), 10**12, 2**62]:
        for turn in range(draw.choice([0, 1, 2, 3, 4, 7])):
            rows.append((conv_id, turn if draw.random() < 0.9 else None, draw.choice(["user", "tool", None, ""]), draw.choice(["a b", "c", "", None, " \n"])))
    long = [(turn, draw.choice(["user", "assistant"]), f"turn {turn} of many") for turn in range(300)]
    for conv_id in range(400, 440):  # several share hundreds of turns, some end early
        rows.extend((conv_id, *turn) for turn in long[: draw.choice([300, 300, 128, 64, 63, 65, 129])])
        if conv_id % 3 == 0:
            rows.append((conv_id, 900, "user", f"own end {conv_id}"))
    rows.extend((None, 0, "user", "no conversation") for _ in range(3))
    rows.extend(rows[:20])
    rows.extend((1000 + n, 0, "user", "the same") for n in range(9000))  # one end with members in several chunks
    rows.append((77, 0, "user", "x " * 100_000))
    table = spark.createDataFrame([(*row, 1, "p", True) for row in rows], "conv_id long, turn long, role string, text string, depth int, parent string, last boolean")
    assert nodes(prefix_trie.prefix_nodes(table.repartition(7))) == trie(rows)
    assert prefix_trie.prefix_nodes(table.where("false")).collect() == []


def test_conversation_without_turns_is_a_member_of_the_root(spark):
    alone = next(c for c in range(21, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    found = prefix_trie.prefix_nodes(spark.createDataFrame([(alone, 0, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert nodes(found) == [(alone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


# URL filter


def parts(url):
    url = url or ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruling(url):
    host, path = parts(url)
    fitting = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.name), default=None)
    return (host, path, best.name, best.verdict) if best else (host, path, None, None)


ODD_URLS = [
    None, "", "://", "x", "http:/a.com/", "HTTP://EXAMPLE.COM/en/1", "http://example.com/en/", "http://www.example.com/en/x", "http://a.www.example.com/en/x",
    "http://wwww.example.com/en/x", "http://notexample.com/en/", "http://example.com/en", "http://example.com", "http://example.com?x=/en/", "http://com/",
    "http://net/es/", "http://a.net/fr/x?y#z", "http://a.net/FR/", "http://a.net#/fr/", "http://É.net/es/ü", "a://b://c.com/", "http://xcom/", "http://a..com/x",
    "http://host/" + "segment/" * 40_000, "http://" + "a." * 3000 + "org/", "http://x.org/\n/y", "http://x.org/%zz?&&=", "http://İ.com/",
]


def test_rules(spark, folder, connection):
    urls = dict(connection.execute("SELECT page_id, url FROM pages").fetchall())
    found = QUERIES["op11_url_filter"](spark, folder).collect()
    assert sorted(r["page_id"] for r in found) == sorted(urls)
    for r in found:
        host, path, rule, verdict = ruling(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
        if not rule:
            assert (r["verdict"] == "block") == (r["block_score"] >= 0.5)


def test_odd_urls(spark):
    rows = [(n if n % 5 else None, url, "h", "p", "r", 1.0) for n, url in enumerate(ODD_URLS * 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, blocked double")
    found = url_filter.judge_urls(table, URL_RULES).collect()
    expected = Counter((n, *ruling(url)[:3]) for n, url, *_ in rows)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in found) == expected
    assert all(r["verdict"] == next(x.verdict for x in URL_RULES if x.name == r["rule"]) for r in found if r["rule"])
    assert url_filter.judge_urls(table.where("false"), URL_RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judge_urls(table, []).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filter.judge_urls(table, [url_filter.Rule("block", "com", "/")]).collect()} == {"block"}


def test_trees_on_held_out_urls(spark):
    """Machine-made urls (digits, many parameters, deep paths) against plain ones, under suffixes that differ in their share of them."""
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(signs, least, most):
        return "".join(draw.choice(signs) for _ in range(draw.randint(least, most)))

    rows = []
    for n in range(1600):
        bad = int(draw.random() < 0.4)
        site = draw.choice(["top", "biz", "org"] if bad else ["org", "com", "org"])
        if bad:
            url = f"http://{word(letters + '0123456789-', 12, 24)}.{site}/{'/'.join(word('0123456789', 3, 9) for _ in range(draw.randint(1, 6)))}?" + "&".join(f"{word(letters, 1, 2)}={word('0123456789abcdef', 6, 16)}" for _ in range(draw.randint(0, 6)))
        else:
            url = f"http://{draw.choice(['www.', ''])}{word('abcde', 4, 9)}.{site}/{draw.choice(['news', 'about', 'blog'])}/{word('abcde', 4, 9)}" + draw.choice(["", ".html", "?page=2"])
        rows.append((n, url, bad))
    pages = spark.createDataFrame([(n, url) for n, url, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(url, bad) for n, url, bad in rows if n % 4], "url string, blocked int")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [], labels).collect()}
    held_out = [(bad, verdicts[n] == "block") for n, _, bad in rows if n % 4 == 0]
    assert sum(bad == found for bad, found in held_out) >= 0.95 * len(held_out)


def test_entropy_and_lexical():
    assert url_filter.entropy("") == 0 and url_filter.entropy("aaaa") == 0 and url_filter.entropy("abcd") == 2
    found = url_filter.lexical(b"http://a-1.b.c/x/yy.html?p=1&&q#f")
    assert found[1:7] == [7.0, 9.0, 6.0, 1.0, 2.0, 3.0] and found[11:] == [2.0, 1.0, 1.0, 0.0]
