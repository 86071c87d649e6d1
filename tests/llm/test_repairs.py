"""Hostile pages and arguments, marks and menus of pages, flows of many sources."""

import itertools
import json
import random
import time

import pytest

from nearname.llm import mixing, tool_calls, wrappers
from tests.llm.test_operators import texts_of


def test_hostile_tag_names(spark):
    bodies = ["<p>text</p><x)+>boom</x)+>", "<p>text<p)?>boom", "<(a)+>text boom</(a)+>", "<p>text boom</p><x\"y>", '<"+",["a>text boom', "<p>text< b>boom"]
    got = texts_of(spark, [("http://h.example/", b) for b in bodies] + [(f"http://h{i}.example/", b) for i, b in enumerate(bodies)])
    assert len(got) == 2 * len(bodies) and all("boom" in t or "text" in t for t in got)
    for tokens in (("<x)+", ("+", ("#a)?", ("?", ("/",)))), " "), ()):
        assert wrappers.parse(wrappers.show(tokens)) == tokens


def test_compound_marks(spark):
    story = "<div class=story><p>text</p></div>"
    beside = [
        '<div class="comments-area">no</div>', '<ol id="comment-list"><li>no</ol>', '<div class="main-nav">no</div>', '<div class="cookie-banner">no</div>',
        '<div class="ad-slot">no</div>', '<div class="site-header">no</div>', '<div class="x site_footer">no</div>',
    ]
    whole = [
        '<div class="post share">text</div>', '<div class="widget entry">text</div>', '<div class="content social">text</div>', '<div class="social">text</div>',
        '<div class="page has-sidebar"><p>text</div>', '<div class="sidebar"><article>text</article></div>', '<div id="comments"><p>text</div>',
    ]
    pages = [(f"http://a{i}.example/", story + b) for i, b in enumerate(beside)] + [(f"http://b{i}.example/", b) for i, b in enumerate(whole)]
    assert texts_of(spark, pages) == ["text"] * len(pages)


MENU = "<div class=c7><ul>%s</ul></div><div class=c8><p>Story %d with <a href=/x>a link</a> and <a href=/y>another</a> is told.</p><p><a href=/z>One %d</a></p></div>"


def menu_pages(host="http://h.example/"):
    lists = [[f"Item{i}{j}" for j in range(2 + i)] for i in range(4)]
    return [(host, MENU % ("".join(f"<li><a href=/{x}>{x}</a></li>" for x in words), i, i)) for i, words in enumerate(lists)]


def test_the_wrapper_finds_menus(spark):
    """Items differ from page to page and their elements bear no mark: only the repeated group
    of links in the expression tells. Without it they stay."""
    want = [f"Story {i} with a link and another is told. One {i}" for i in range(4)]
    assert texts_of(spark, menu_pages()) == want
    tokens = wrappers.parse(wrappers.infer_wrappers(spark.createDataFrame([(0, *p) for p in menu_pages()], "page_id long, url string, html string")).first()["wrapper"])
    assert wrappers.menus(tokens) == {"div.c7/ul/li/a"}
    layout = wrappers.main_slots(wrappers.slots(tokens))
    found = wrappers.pieces(menu_pages()[1][1])
    assert "Item10" in wrappers.main_text(found, layout) and "Item10" not in wrappers.main_text(found, wrappers.main_slots(wrappers.slots(tokens), wrappers.menus(tokens)))
    inside = "<article><ul><li><a href=/1>kept</a><li><a href=/2>too</a></ul></article>"
    assert texts_of(spark, [("http://i.example/", inside)]) == ["kept too"]
    only = "<ul><li><a href=/1>all</a><li><a href=/2>there is</a></ul>"  # a page is not emptied
    assert texts_of(spark, [("http://o.example/", only), ("http://n.example/", "<a name=top>named<p>text")]) == ["all there is", "named text"]


def test_little_text_beside_a_template(spark):
    page = "<div class=c1>" + "constant words " * 40 + "</div><p>two %d</p>"
    assert texts_of(spark, [("http://h.example/", page % i) for i in range(5)]) == [f"two {i}" for i in range(5)]


def slow_fold(tokens):
    size = 1
    while size <= min(12, len(tokens)):
        for i in range(len(tokens) - 2 * size + 1):
            if tokens[i : i + size] == tokens[i + size : i + 2 * size]:
                return True
        size += 1
    return False


def test_repeats_are_seen():
    rng = random.Random(4)
    for _ in range(300):
        tokens = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        codes = wrappers._numbered(tokens)
        assert any(wrappers._repeats(codes, k) for k in range(1, min(12, len(tokens)) + 1)) == slow_fold(tokens)
        folded = wrappers.fold(tokens)
        assert not any(folded[i] == folded[i + 1] for i in range(len(folded) - 1))


def test_large_irregular_page():
    rng = random.Random(6)
    names = ["p", "div", "b", "ul", "li", "h2", "td"]
    page = "".join(f"<{n} class=c{rng.randint(0, 500)}>word {rng.random()}</{n}>" for n in rng.choices(names, k=25_000))
    start = time.process_time()
    wrappers.skeleton(page)
    assert time.process_time() - start < 6 * len(page) / 1e6 + 2


@pytest.mark.parametrize(
    "text, error",
    [
        ("[" * 100_000 + "]" * 100_000, "$: nested too deep"), ("[" * 300 + "]" * 300, "$: nested too deep"), ("1e999", "$: number out of range"),
        ('{"text":[-1e999]}', "$: number out of range"), ("NaN", "$: no JSON"), ("[Infinity]", "$: no JSON"), ("{", "$: no JSON"), ("9" * 5000, "$: no JSON"),
        ('{"text":"\\ud800","turn":1}', None), ('{"\\udfff":1,"text":"","turn":1}', "/\\udfff: unknown"), ("[" * 150 + "]" * 150, "$: not object"),
        ('{"text":"😀","turn":1,"context":{"$result":"\\udc00"}}', "$: no call \\udc00"),
    ],
)
def test_awkward_arguments(spark, text, error):
    calls = spark.createDataFrame([(1, "a", 0, "reply", text)], "conv_id long, call_id string, position long, name string, arguments string")
    results = spark.createDataFrame([(1, "a", 1, "done")], "conv_id long, call_id string, position long, content string")
    (row,) = tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()
    assert row["errors"] == ([error] if error else []) and row["status"] == "linked"
    strict = json.loads(row["json"], parse_constant=lambda name: pytest.fail(name))
    assert strict["result"] == "done" and strict["valid"] == (error is None)
    row["json"].encode()


def test_flow_against_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        names = ["a", "b", "c"][: rng.randint(1, 3)]
        sets = rng.sample([c for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)], rng.randint(1, min(3, 2 ** len(names) - 1)))
        patterns = [(p, rng.randint(1, 6)) for p in sets]
        plan = mixing.plan_mix(patterns)
        goal = {s: round(t) for s, t in plan.targets.items()}

        def cost(used):
            return sum(sum(max(0, min(u - k * n, n)) * k * k for k in range(3)) for u, (_, n) in zip(used, patterns))

        best = (-1, 0)  # most tokens placed, then least cost
        arcs = [(i, s) for i, (p, _) in enumerate(patterns) for s in p]
        if len(arcs) > 4:
            continue
        for amounts in itertools.product(*[range(min(goal[s], 3 * patterns[i][1]) + 1) for i, s in arcs]):
            used, met = [0] * len(patterns), dict.fromkeys(goal, 0)
            for (i, s), n in zip(arcs, amounts):
                used[i] += n
                met[s] += n
            if all(u <= 3 * n for u, (_, n) in zip(used, patterns)) and all(met[s] <= goal[s] for s in goal):
                best = max(best, (sum(amounts), -cost(used)))
        used = [sum(t.values()) for t in plan.taken]
        assert (sum(used), -cost(used)) == best


def test_flow_of_very_many_sources():
    rng = random.Random(9)
    patterns = [((f"s{i}",), rng.randint(1, 10**6)) for i in range(100_000)] + [(("s1", "s2", None), 50), ((None,), 7)]
    start = time.process_time()
    plan = mixing.plan_mix(patterns)
    assert time.process_time() - start < 20
    assert all(sum(t.values()) <= 3 * n for t, (_, n) in zip(plan.taken, patterns))
    alone = [(sum(t.values()), plan.targets[p[0]]) for t, (p, _) in zip(plan.taken[3:100_000], patterns[3:])]
    assert all(abs(got - goal) <= 1 for got, goal in alone)
