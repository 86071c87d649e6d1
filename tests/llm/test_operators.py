"""The training-data operators against brute force on small, awkward tables."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearname.llm import ann, exact_dedup, language, mixing, packing, secrets, sharding, simhash, tool_calls, wrappers
from nearname.llm.components import components
from nearname.session import reliable_checkpoint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part int"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "zeta", "iota"]


def rows():
    rng = random.Random(4)
    out = []
    for i in range(120):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))
        out.append([i, text, "en", f"s{i % 3 if i % 2 else 0}", len(text)])
    near = " ".join(WORDS * 40)
    out += [[200, near, "en", "s0", 1], [201, near + " alpha", "en", "s0", 1], [202, near.upper() + " beta", "en", "s1", 1]]
    out += [[300 + i, "one  copy\there", "en", "s0", 1] for i in range(40)] + [[400, "one copy here", None, "s2", 1]]
    out += [[500, None, None, None, None], [501, "", "en", "s0", 0], [502, " \t\n", "en", None, 3], [None, "no id at all", "en", "s0", 1]]
    out += [[600, "x " * 30_000, "en", "s1", 1], [7, out[7][1], "en", out[7][3], 1]]
    return [(*r, "clash", 1) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return reliable_checkpoint(spark.createDataFrame(rows(), SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_shards(docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows())
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(empty).count() == 0


def test_ring():
    loads = {c: (random.Random(c).randint(0, 9), random.Random(c).randint(1, 900)) for c in range(0, 1 << sharding.RING_BITS, 7)}
    pieces = sharding.walk(loads, 5, "bytes", slack=0.05)
    held = Counter()
    for cell, _, _, shard, _, _ in pieces:
        held[shard] += loads[cell][1]
    total = sum(loads[c][1] for c, *_ in pieces)
    assert max(held.values()) <= total / 5 * 1.06 + 900
    few, more = dict(sharding.ring(5)), dict(sharding.ring(6))
    assert all(more[c] == s for c, s in few.items() if more[c] != 5)  # a new shard takes nodes, others keep theirs
    # Few rows move when a shard is added, and most of them to the new one.
    before = {(c, k): s for c, lo, hi, s, _, _ in sharding.walk(loads, 5) for k in range(lo, hi)}
    after = {(c, k): s for c, lo, hi, s, _, _ in sharding.walk(loads, 6) for k in range(lo, hi)}
    assert sum(before[k] != after[k] for k in before) < 0.5 * len(before)


def test_mix(docs, empty):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows()) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(got, key=str) == sorted(mixing.mix_documents(docs).collect(), key=str)
    sizes, taken, goal = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert sizes == Counter({s: sum(len(words(r[1])) for r in rows() if r[3] == s) for s in goal})
    assert all(abs(goal[s] - taken[s]) <= 1 for s in goal) and abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    assert mixing.mix_documents(empty).count() == 0 and mixing.take_mix(empty).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns


def test_flow_of_overlapping_sources():
    patterns = [(("a",), 100), (("a", "b"), 50), (("b",), 10), ((None,), 5)]
    plan = mixing.plan_mix(patterns, {"a": 1, "b": 1, None: 1})
    for s in ("a", "b", None):
        assert abs(sum(t.get(s, 0) for t in plan.taken) - plan.targets[s]) <= 1
    used = [sum(t.values()) for t in plan.taken]
    assert all(u <= 3 * n for u, (_, n) in zip(used, patterns))

    def cost(us):  # passes cost 0, 1, 4 per token
        return sum(sum(max(0, min(u - k * n, n)) * k * k for k in range(3)) for u, (_, n) in zip(us, patterns))

    a, b, none = (round(plan.targets[s]) for s in ("a", "b", None))
    best = min(cost((a - x, x + y, b - y, none)) for x in range(a + 1) for y in range(b + 1) if a - x <= 300 and x + y <= 150 and b - y <= 30)
    assert cost(used) == best


def test_packing(docs, empty):
    rng = random.Random(3)
    for _ in range(30):
        histogram = {rng.randint(0, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        k = rng.randint(1, 4)

        def waste(ends):
            return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())

        tops = sorted(histogram)
        best = min(waste([*c, tops[-1]]) for m in range(k) for c in itertools.combinations(tops[:-1], m))
        ends = packing.best_boundaries(histogram, k)
        assert len(ends) <= k and waste(ends) == best
    got = packing.pack_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows())
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["bucket_length"] - r["n_words"] >= 0
        batches[r["bucket"], r["batch"]].append(r)
    for held in batches.values():
        assert len(held) == 1 or len(held) * held[0]["bucket_length"] <= packing.BUDGET
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("budget", [60, 600, exact_dedup.TABLE_BYTES])
def test_exact_dedup(docs, empty, budget):
    got = exact_dedup.exact_groups(docs.repartition(6), budget=budget).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_drop_copies(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})


def test_open_table_compares_contents():
    table = exact_dedup.OpenTable()
    assert [table.find_or_add(1, t) for t in ("a", "b", "a", "b")] == [0, 1, 0, 1]
    assert len({table.find_or_add(h, str(h)) for h in range(5000)}) == 5000


def brute_fingerprint(text):
    w = words((text or "").translate(str.maketrans(simhash.UPPER, simhash.LOWER)))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(values, radius=3):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= radius:
            parent[find(a)] = find(b)
    return [find(x) for x in range(len(values))]


def test_simhash(docs, empty):
    table = rows()
    prints = [brute_fingerprint(r[1]) for r in table]
    roots = parts(prints)
    least = {}
    for root, r in zip(roots, table):
        if r[0] is not None:
            least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(table, prints, roots))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert least[roots[[r[0] for r in table].index(201)]] == 200
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("most", [2, 4096])
def test_links_connect_what_is_near(spark, most):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:8]:
        for _ in range(12):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = components(simhash.links(reliable_checkpoint(fps), most)).collect()
    root = {r["node"] & (2**64 - 1): r["root"] for r in found}
    groups, want = defaultdict(set), defaultdict(set)
    for v, p in zip(values, parts(values)):
        groups[root.get(v, v)].add(v)
        want[p].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_tree_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 16)) * 3
    vectors = centres[rng.integers(0, 10, 800)] + rng.normal(size=(800, 16))
    vectors[500:540] = vectors[3]
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, [1.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search_embeddings(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 800, 20))
    hits = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        want = sorted((i for i in range(800) if i != q), key=lambda i: (-scores[i], i))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(math.isclose(s, scores[i], rel_tol=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want))
    assert hits >= 0.9 * 20 * len(got)
    few = ann.search_embeddings(frame.where("vec_id < 5")).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]
    assert ann.search_embeddings(frame.limit(0)).count() == 0


def test_tree_search_reaches_its_recall(spark):
    # Without clusters the neighbours lie in many leaves, and all queries are trial queries.
    vectors = np.random.default_rng(2).normal(size=(2000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search_embeddings(frame).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & set([i for i in np.argsort(-(vectors @ vectors[q])) if i != q][:20])) for q in got)
    assert len(got) == 100 and hits >= 0.97 * 20 * len(got)


PAGE = (
    "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    '<nav><ul><li><a href="/">home</a></li></ul></nav><div class="sidebar">side</div><!-- no <p> here -->'
    "<article><h1>Big&nbsp;title</h1><p>One <b>bo</b>ld<br>line &lt;x&gt;<p>Two\n\n  lines</p>%s"
    '<div class="comments"><p>first!</p></div></article><form>say</form><footer>&copy; me</footer></body></html>'
)


def test_wrappers(spark):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE % ("<p>more</p>" * i)) for i in range(12)]
    pages += [(90, None, "<p>plain"), (91, "http://h1.example/x", None), (92, "http://h0.example/cut", (PAGE % "")[:330]), (93, "http://h0.example/cut", PAGE[: PAGE.index("ld<br>")]), (0, pages[0][1], pages[0][2])]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = defaultdict(set)
    for r in wrappers.extract_pages(frame).collect():
        got[r["page_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(12):
        assert got[i] == {"Big title One bold line <x> Two lines" + " more" * i}
    assert got[90] == {"plain"} and got[91] == {""}
    assert got[92] == {"Big title One bold line <x> Two lines"}  # ends inside the comments
    assert got[93] == {"Big title One bo"}  # ends inside the article
    rules = wrappers.infer_wrappers(frame, group=2).collect()
    assert len(rules) == 3 and sum(r["pages"] for r in rules) == len(pages)
    assert all(wrappers.show(wrappers.parse(r["wrapper"])) == r["wrapper"] for r in rules)
    assert wrappers.extract_pages(frame.limit(0)).count() == 0


def texts_of(spark, pages):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.extract_pages(frame).orderBy("page_id").collect()]


def test_wrappers_judge_whole_marks(spark):
    bodies = [
        '<body class="has-sidebar"><article>text</article>', '<body class="sidebar"><p>text', '<html class="no-sidebar custom-header"><p>text',
        '<div class="page with-sidebar"><p>text</p></div>', '<article class="post social-policy">text</article>', '<article class="social">text</article>',
        '<div id="share-prices">text</div>', '<div data-id="ad" data-role="banner" title=\'x class="ad"\'>text</div>', '<main id=related>text</main>',
        '<div class="post w-1/2 (x)+ a.b">text</div>', '<p>text</p><div class="x AD">no</div><div id=\'sidebar\'>no</div><div role=banner>no</div>',
    ]
    assert texts_of(spark, [(f"http://h{i}.example/", b) for i, b in enumerate(bodies)]) == ["text"] * len(bodies)


def test_wrappers_of_a_host_with_two_layouts(spark):
    new, old = "<nav>menu</nav><article><p>new %d</p></article><p>around</p>", "<nav>menu</nav><div class=post><p>old %d</p></div>"
    pages = [(url, body % i) for url in ("http://h.example/", None) for i in range(3) for body in (new, old)] + [("http://h.example/e", "<article> </article><p>old 9")]
    assert texts_of(spark, pages) == [f"{kind} {i}" for _ in range(2) for i in range(3) for kind in ("new", "old")] + ["old 9"]


def test_wrappers_leave_out_constant_text(spark):
    page = "<div class=c7>Home News</div><div class=c8><p>Accept our terms.</p><p>The story number %d is told here at some length.</p></div>"
    told = "The story number %d is told here at some length."
    pages = [("http://h.example/", page % i) for i in range(5)] + [("http://h.example/", "<div class=c7>Home News</div><div class=c9>other layout</div>")]
    # What all of a host's pages share is its template, however little is left. A page of nothing
    # else, two pages only, and pages without a host have none.
    same = "<div class=c1>one copied text</div><p>%d"
    pages += [("http://copies.example/", same % i) for i in range(4)] + [("http://copies.example/same", same % 0)]
    pages += [("http://two.example/", page % i) for i in range(2)] + [("http://two.example/", page % 1)] + [(None, page % i) for i in range(3)]
    full = "Home News Accept our terms. " + told
    want = [told % i for i in range(5)] + ["other layout"] + [str(i) for i in (0, 1, 2, 3, 0)] + [full % i for i in (0, 1, 1, 0, 1, 2)]
    assert texts_of(spark, pages) == want


def test_wrappers_keep_text_after_raw_elements(spark):
    bodies = [
        '<svg class="i" viewBox="0 0"/><p>text', "<object data=x /><p>text</p><svg><text>no</text></svg>", "<svg/><p>text</p><svg><g/></svg>",
        "<div><select><option></div><p>text", "<select><p>text</p><select><option>no</select>", "<noscript><p>text", "<template><p>text", "<iframe src=x><p>text",
        "<title-bar>text</title-bar>", "<select-box>text</select-box>", "<style-guide>text", "<style>no</style-guide>no</style >text", "<svg><svg>no</svg>no</svg>text",
        "text<script>no", "text<style>no</styl", "<SCRIPT>'<svg>'</SCRIPT>text<svg>no</svg>", "text<!-- no", "text<textarea>no", "<title>no</title><p>text</p><a hre", "<p>text</p></",
    ]
    assert texts_of(spark, [(f"http://h{i}.example/", b) for i, b in enumerate(bodies)]) == ["text"] * len(bodies)
    assert texts_of(spark, [("http://t.example/", "<b>a</b><3 thanks"), ("http://t.example/", "<p>< 5 percent")]) == ["a<3 thanks", "< 5 percent"]


def test_alignment_has_optionals_and_repeats():
    a, b = ("<ul", "<li", "/li", "/ul"), tuple(wrappers.fold(["<ul", *["<li", "/li"] * 3, "/ul", "<p", "/p"]))
    assert wrappers.align(a, b) == ("<ul", ("+", ("<li", "/li")), "/ul", ("?", ("<p",)), ("?", ("/p",)))


def test_secrets(spark):
    key = "AKIA" + "Q7ZJ2XW9BDE4KLMN"
    hexes = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [
        f'é😀 token = "{hexes}" then {key}x', "secret: token : abcdefgh", "PassWord=ab", "api_key:'Zx9_kQ2-pL7vT4'", None, "", "x " * 5000 + key,
        "abcdefghijklmnopqrstuvwxyzabcdef", f"{hexes}g", "token=token=abcdefgh",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = {
        "assign": r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    found = {r["doc_id"]: r for r in secrets.secret_table(frame).collect()}
    for i, text in enumerate(texts):
        spans = []
        for order, (kind, pattern) in enumerate(base.items()):
            for m in re.finditer(pattern, text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                    spans.append((m.start(), order, kind, m.end()))
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        assert found[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), text
        assert set(joined.split(",")) - {""} <= set(found[i]["spans"].split(","))
    assert "entropy_hex" in found[0]["spans"] and "entropy" not in found[7]["spans"]
    assert secrets.secret_table(frame.limit(0)).count() == 0
    rng = random.Random(2)
    tokens = ["".join(rng.choice("abcdef0123456789XYZ+/_-") for _ in range(rng.randint(16, 60))) for _ in range(30)]

    def entropy(s):
        return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())

    best = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.window_entropy(F.col("t")).alias("e")).collect()
    for r in best:
        assert math.isclose(r["e"], max(entropy(r["t"][i : i + 16]) for i in range(len(r["t"]) - 15)), abs_tol=1e-9)


def test_tool_calls(spark):
    schemas = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {}}, "required": ["x"], "additionalProperties": False}}
    calls = [
        (1, "a", 0, "add", '{"y": {"$result": "b"}, "x": 1}'), (1, "b", 1, "add", '{"x": 2}'), (1, "b", 2, "add", '{"x": 3}'),
        (1, "c", 3, "add", '{"x": "no", "z": 1}'), (1, "d", 4, "none", "{}"), (1, "e", 5, "add", "{"), (1, "f", 6, "add", '{"x": 1, "y": {"$result": "gone"}}'),
        (2, "p", 0, "add", '{"x": 1, "y": {"$result": "q"}}'), (2, "q", 1, "add", '{"x": 1, "y": {"$result": "p"}}'), (3, None, 0, "add", None),
    ]
    results = [(1, "a", 9, "ra"), (1, "b", 9, "rb"), (1, "b", 10, "rb2"), (1, "zz", 11, "lost"), (3, None, 1, "x"), (1, "c", 9, None)]
    left = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string")
    right = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string")
    got = tool_calls.link_calls(left, right, schemas).collect()
    assert len(got) == 12
    by = {(r["conv_id"], r["call_id"], r["position"]): r for r in got}
    assert by[1, "a", 0]["level"] == 1 and by[1, "b", 1]["level"] == 0  # a waits for b
    assert json.loads(by[1, "b", 1]["json"])["result"] == "rb" and json.loads(by[1, "b", 2]["json"])["result"] == "rb2"
    assert by[1, "a", 0]["json"] == '{"arguments":{"x":1,"y":{"$result":"b"}},"id":"a","name":"add","result":"ra","valid":true}'
    assert by[1, "c", 3]["errors"] == ["/x: not integer", "/z: unknown"] and by[1, "d", 4]["errors"] == ["$: no such tool"]
    assert by[1, "e", 5]["errors"] == ["$: no JSON"] and by[1, "f", 6]["errors"] == ["$: no call gone"]
    assert {by[2, c, i]["status"] for i, c in enumerate("pq")} == {"cycle"} and by[1, "zz", 11]["status"] == "orphan"
    assert Counter(r["status"] for r in got if r["conv_id"] == 3) == Counter(["unanswered", "orphan"])
    assert tool_calls.link_calls(left.limit(0), right.limit(0), schemas).count() == 0


def test_language(spark, empty):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(5000, None, "en"), (5001, "", "en"), (5002, "12 34 !!", "en"), (5003, "Жизнь прекрасна и удивительна", None), (None, "is the", None)], "doc_id long, text string, lang string")
    table = base.select("doc_id", "text", "lang").unionByName(odd)
    got = {r["doc_id"]: r for r in language.language_table(table).collect()}
    truth = {r["doc_id"]: r["lang"] for r in base.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (5000, 5001, 5002)] == ["und"] * 3 and got[5003]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([not got[i]["rejected"] for i in truth]) > 0.99
    assert language.language_table(empty).count() == 0
    unlearnt = language.language_table(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")).first()
    assert unlearnt["lang_pred"] == "und"


def test_clashing_columns_stay(docs):
    """Columns named like the operators' own are carried through unchanged."""
    names = ["id", "tie", "count", "_id", "_tie", "_count", "_own", "_row", "_n", "_pass", "__language", "_TIE_"]
    wide = reliable_checkpoint(docs.select("*", *[F.lit(n).alias(n) for n in names]))
    model = language.fit_documents(docs)
    assert model.langs
    for kept in (exact_dedup.drop_copies(wide), simhash.keep_one(wide), mixing.take_mix(wide), language.keep_known(wide)):
        assert kept.columns == wide.columns
        left = kept.collect()
        assert left and all(r[n] == n for r in left for n in names)
