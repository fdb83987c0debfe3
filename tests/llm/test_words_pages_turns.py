"""Spelling variants, main texts of pages, repaired conversations: each against a plain version."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_tables import FOLDER, pairs

from scrubline.llm import conversations, spelling, wrappers
from scrubline.llm.queries import QUERIES

LOWER = {65 + k: 97 + k for k in range(26)}


def counted(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near_sets(words):
    """Words by what is left when one code point is taken out or masked."""
    masked, shorter = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            masked[w[:k], w[k + 1 :]].add(w)
            shorter[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in masked.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    for w in words:
        for longer in shorter.get(w, ()):
            near[w].add(longer), near[longer].add(w)
    return near


def plain_variants(words):
    near, form = near_sets(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


def rows_of(df):
    return {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()}


@pytest.mark.parametrize("table", ["odd", "repeated", "documents"])
def test_variants_of_texts(request, table):
    df = request.getfixturevalue(table)
    got = spelling.variants(spelling.count_words(spelling.misspelt(spelling.runs(df))))
    assert rows_of(got) == plain_variants(counted(pairs(df)))


def test_variants_query_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert rows_of(QUERIES["op11_spelling_variants"](spark, folder)) == plain_variants(counted(pairs(docs)))


@pytest.mark.parametrize("limit", [3, 40, 2048])
def test_full_buckets_are_halved(spark, monkeypatch, limit):
    rng = random.Random(limit)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", limit)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 8))): rng.randint(1, 50) for _ in range(900)}
    words |= {"long" * 3000: 9, "long" * 2999 + "lng": 4, "𝔘𝔘𝔘": 8, "𝔘𝔘": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    assert rows_of(spelling.variants(df)) == plain_variants(words)


def test_tiles_of_any_height(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_ROWS", 5)
    monkeypatch.setattr(spelling, "CHUNK_ROWS", 17)
    words = {f"w{a}{b}{c}": a * b + c + 1 for a in range(6) for b in range(6) for c in range(6)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.variants(df)) == plain_variants(words)


def test_no_words(empty):
    assert spelling.variants(spelling.count_words(spelling.misspelt(spelling.runs(empty)))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(empty, ratio=1)


# --- pages ---


def main(text):
    return "\n\n".join(b for b in (" ".join(b.split()) for b in text) if b)


def extracted(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, node int").repartition(3)
    return {r["page_id"]: r["text"] for r in wrappers.extract(df, **kw).collect()}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op12_main_text"](spark, FOLDER).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = [html.unescape(re.sub("<[^>]*>", "", b)) for b in re.split("</?(?:p|h1)>", article)]
        text, url = main(blocks), r["url"]
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["url"]) == (text, url)
        assert got[r["page_id"]]["n_chars"] == len(text)


def test_constant_slots_are_template(spark):
    shape = "<body><div>Site name</div><div class='x{k}'><p>Story {k}</p><p>More of {k}</p></div><div>All rights</div>"
    rows = [(k, "http://a.example/x", shape.format(k=k), "h", 1) for k in range(12)]
    rows += [(100 + k, "http://b.example/x", shape.format(k=k), "h", 1) for k in range(3)]
    got = extracted(spark, rows)
    assert all(got[k] == f"Story {k}\n\nMore of {k}" for k in range(12))
    # too few pages to tell: all stays
    assert got[100] == "Site name\n\nStory 0\n\nMore of 0\n\nAll rights"


def test_copies_make_no_template(spark):
    page = "<article><h1>Same title</h1><p>Same text</p></article><footer>{k}</footer>"
    rows = [(k, "http://c.example", page.format(k=k % 2), "h", 1) for k in range(30)]
    rows += [(50 + k, "http://d.example", page.format(k=k), "h", 1) for k in range(30)]
    got = extracted(spark, rows)
    assert set(got.values()) == {"Same title\n\nSame text"}


ODD_PAGES = {
    "": "",
    "plain words": "plain words",
    "<p>a<p>b<b>old</b> c<br>d": "a\n\nbold c d",
    "<script>var t='</p><p>x';</script><p>y</p><style>p{}": "y",
    "<!-- <p>no</p> --><p>a &amp;lt; b&nbsp;&eacute; &#x41;&#65 &bogus;</p>": "a &lt; b é AA &bogus;",
    "<div title='a > b' class=ok>in</div><textarea><p>no</p></textarea>": "in",
    "<nav>menu</nav><main><p>body</p><div class='comments'><article>hi</article></div></main>": "body",
    "<article><header><h1>T</h1></header><p>x</p><footer>f</footer><form>q</form></article><p>out</p>": "T\n\nx",
    "<form><article><p>inside</p></article></form><p>out</p>": "inside",
    "<div class='cookie-notice'>ok?</div><span class='ad'>buy <span>it</span> now</span><p>read</p>": "read",
    "<ul><li>one<li>two <i>too</i></ul>tail": "one\n\ntwo too\n\ntail",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\n\nb\n\nc",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes": "yes",
    "a < b and <3 </ x> c": "a < b and <3 c",
    "<p>&#xD800;x</p>": "�x",
    "<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>end": "deep\n\nend",
    "<p title=\"unclosed>text</p>": "text",
}


def test_odd_pages(spark):
    rows = [(k, None if k % 2 else "not a url", page, "h", 1) for k, page in enumerate(ODD_PAGES)]
    rows += [(1000, "http://x", None, "h", 1), (1000, "http://x", None, "h", 1)]
    got = extracted(spark, rows)
    for k, (page, text) in enumerate(ODD_PAGES.items()):
        assert got[k] == text, page[:80]
    assert got[1000] == ""
    assert extracted(spark, []) == {}


def test_a_very_long_page(spark):
    words = "<p>" + "<i>word</i> " * 60_000 + "</p>" + "<p>x</p>" * 20_000
    got = extracted(spark, [(1, "http://x", words, "h", 1)])
    assert got[1] == main([" ".join(["word"] * 60_000)] + ["x"] * 20_000)


def plain_matching(a, b):
    if a[0].split(".")[0] != b[0].split(".")[0]:
        return 0
    best = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for rows in itertools.combinations(a[1], n):
            for columns in itertools.combinations(b[1], n):
                if all(r[0].split(".")[0] == c[0].split(".")[0] for r, c in zip(rows, columns)):
                    best = max(best, sum(plain_matching(r, c) for r, c in zip(rows, columns)))
    return 1 + (a[0] == b[0]) + best


def random_tree(rng, depth=0):
    labels = ["div", "div.a", "p", "ul"]
    return [rng.choice(labels), [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3) if depth < 2 else 0)]]


def test_tree_matching_is_the_heaviest():
    rng = random.Random(4)
    for _ in range(60):
        a, b = random_tree(rng), random_tree(rng)
        a[0] = b[0] = "body"
        matched = wrappers.align(a, b)
        (left, _, above), (right, _, over) = wrappers._flat(a), wrappers._flat(b)
        assert sum(1 + (left[i] == right[j]) for j, i in matched.items()) == plain_matching(a, b)
        assert all(matched.get(over[j], -1) == above[i] for j, i in matched.items())
        assert list(matched.values()) == sorted(set(matched.values()), key=list(matched.values()).index)


# --- conversations ---

NEXT_ROLE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows, faults):
    """Cost, audit and lines of the best edit, by trying all with strings (rows of role, text)."""
    best = {}
    for at in range(len(rows), -1, -1):
        now = {}
        if at == len(rows):
            now = {0: (0, "", ()), 3: (0, "", ())}
        else:
            role, text = rows[at]
            extra = 3 * (faults[at] == "truncated")
            for q in range(4):
                ways = []
                if q in best[at + 1]:
                    c, a, lines = best[at + 1][q]
                    ways.append((c + 4, "D" + a, lines))
                if faults[at] not in ("blank", "duplicate"):
                    to = KEPT.get((q, role[:1]))
                    if to in best[at + 1]:
                        c, a, lines = best[at + 1][to]
                        ways.append((c + extra, "K" + a, (f"{role}:{text}", *lines)))
                    wanted, to = NEXT_ROLE[q]
                    if to in best[at + 1]:
                        c, a, lines = best[at + 1][to]
                        ways.append((c + 3 + extra, "R" + a, (f"{wanted}:{text}", *lines)))
                if ways:
                    now[q] = min(ways)
        for _ in range(6):
            for q in range(4):
                wanted, to = NEXT_ROLE[q]
                if to in now:
                    way = (now[to][0] + 3, "I" + now[to][1], (f"{wanted}:", *now[to][2]))
                    now[q] = min(now[q], way) if q in now else way
        best[at] = now
    return best[0][0]


def plain_repair(rows):
    """Figures of every conversation of rows (conv_id, turn, role, text), damaged first."""
    spaced = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        role = "user" if kind == 4 else role
        by[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, turns in by.items():
        digest = lambda t: hashlib.md5(t.encode()).digest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\f\r")
            if not bare:
                faults.append("blank")
            elif (role, text) in seen:
                faults.append("duplicate")
            else:
                faults.append("" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest([r[1:] for r in turns], faults)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(turns):
    got = conversations.repair_digests(conversations.damage(turns), turns).collect()
    found = {r[0]: tuple(r)[1:] for r in got}
    assert len(found) == len(got)
    return found


def test_conversations_of_the_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain_repair([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    got = QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def odd_turns(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    texts = ["Hi.", "Hi.", "ok", "What? ", "", None, "\n\t", "long " * 50 + "!", "é…", "cut off\x0b"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(0, 9)):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows + rows[:20]


@pytest.mark.parametrize("seed", range(4))
def test_odd_conversations(spark, seed):
    rows = odd_turns(seed)
    df = spark.createDataFrame(
        [(*r, "d", 1, 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, nth int, kind int"
    ).repartition(4)
    assert repaired(df) == plain_repair(rows)


def test_text_keys_and_no_rows(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("b", 1, None, None)], "conv_id string, turn int, role string, text string")
    assert repaired(df) == plain_repair([tuple(r) for r in df.collect()])
    assert repaired(df.limit(0)) == {} and conversations.repair(df.limit(0)).count() == 0
    gone = conversations.repair_digests(df.limit(0), df).collect()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows_give_the_digests(spark):
    df = spark.createDataFrame(odd_turns(9), "conv_id long, turn long, role string, text string")
    lines = defaultdict(dict)
    for r in conversations.repair(df).collect():
        assert r["place"] not in lines[r["conv_id"]]
        lines[r["conv_id"]][r["place"]] = f"{r['role']}:{r['text']}"
    for r in conversations.repair_digests(df).collect():
        text = "\n".join(lines[r["conv_id"]][k] for k in range(len(lines[r["conv_id"]])))
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]


def test_automaton_against_strings():
    rng = random.Random(1)
    letters = {"s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "x": ("tool", "")}
    signatures = {"".join(rng.choice("dsuaxSUAXuaua") for _ in range(rng.randint(0, 11))) for _ in range(1500)}
    automaton = conversations.SuffixAutomaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        automaton.add(signature)
        rows = [(letters.get(c.lower(), ("user", ""))[0], "") for c in signature]
        faults = ["blank" if c == "d" else "truncated" if c.isupper() else "" for c in signature]
        assert automaton.best() == cheapest(rows, faults)[:2], signature
    assert automaton.made < sum(map(len, signatures)) and len(automaton.kinds) < 1000


def test_a_long_conversation():
    automaton = conversations.SuffixAutomaton()
    automaton.add("ua" * 200_000 + "u")
    automaton.add("uua" + "ua" * 199_999 + "u")
    cost, audit = automaton.best()
    assert cost == 6 and len(audit) == 400_004 and automaton.made < 400_010
