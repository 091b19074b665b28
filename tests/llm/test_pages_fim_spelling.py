"""Page differencing, fill-in-the-middle and spelling groups."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tapeweave.llm import fim, html_diff, queries, spelling

# ---------------------------------------------------------------- op11


def test_common_lines_are_a_longest_common_subsequence():
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    draw = random.Random(1)
    for _ in range(500):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(14))] for _ in "ab")
        got = html_diff.common_lines(a, b)
        rest = iter(b)
        assert len(got) == len(set(got)) == length(a, b) and all(a[i] in rest for i in got)


def test_markup_that_names_its_parts():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar">
      <header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div id="cookie-notice">We use cookies</div>
      <article class="post"><header><h1>A &amp; B</h1></header><p>One <b>bold</b>
        line<br>broken<p>Two&nbsp;&lt;p&gt; <span class="share">tweet</span>end<script>var x="</p>"</script>
        <form><input><button>Send</button>mail</form><table><tr><td>a<td>b<tr><td>c</table><aside>see also</aside>
        <pre>x  <span class="comment"># y</span></pre><section id="comments"><article class="comment">me too</article></section></article>
      <p>stray</p><footer>&copy; us</footer><!-- <p>gone</p> --></body></html>"""
    lines, kinds = html_diff.page_lines(page)
    kept = [x for x, k in zip(lines, kinds, strict=True) if k != html_diff.FURNITURE]
    assert kept == ["A & B", "One bold line broken", "Two <p> end", "a b", "c", "x # y"]
    lines, kinds = html_diff.page_lines("<main><p>In</p><div class=sidebar>side</div></main><p>Out")
    assert [k for k in kinds] == [html_diff.OPEN, html_diff.FURNITURE, html_diff.FURNITURE]
    for odd in ("", "<", "a < b", "<p", "<script>", "<!--", "</p></div>", "<svg/>x", '<a href="x', "<div" * 50, "<b>" * 500 + "x"):
        html_diff.page_lines(odd)


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def _template(host, body, extra=""):
    return f"<html><body><div>Welcome to {host}</div><div>Home</div><div>{body}</div><div>{extra}Imprint of {host}</div></body></html>"


def _brute(rows):
    """Every page against its neighbours in one sorted list."""
    signed = []
    for i, url, page in rows:
        lines, kinds = html_diff.page_lines(page or "")
        signed.append((i, url, lines, kinds))
    addressed = sorted((html_diff._address(u), -1 if i is None else i, k) for k, (i, u, _, _) in enumerate(signed) if u is not None)
    order = [k for *_, k in addressed]
    out = {}
    for at, k in enumerate(order):
        def sig(j):
            i, u, lines, kinds = signed[j]
            return html_diff.Signature(*html_diff._address(u), lines, [len(x) for x in lines], kinds)

        def key(j):
            return signed[j][2], signed[j][3], html_diff._address(signed[j][1])[0]

        before = next((sig(j) for j in reversed(order[:at]) if key(j) != key(k)), None)
        behind = next((sig(j) for j in order[at + 1 :] if key(j) != key(k)), None)
        out[k] = set(html_diff.template_lines(sig(k), before, behind))
    return sorted(
        (i if i is not None else -1, u or "", "\n".join(x for n, (x, y) in enumerate(zip(lines, kinds, strict=True)) if y != html_diff.FURNITURE and n not in out.get(k, ())))
        for k, (i, u, lines, kinds) in enumerate(signed)
    )


def test_shared_lines_of_unmarked_pages_go(spark):
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        host = "hot.example" if k % 3 else f"h{k % 9}.example"
        body = "</p><p>".join(" ".join(draw.choice(words) for _ in range(30)) for _ in range(3))
        rows.append((k, f"https://{host}/en/{draw.randrange(1000)}", _template(host, f"<p>{body}</p>", f"page {k} - " if k % 7 == 0 else "")))
    # versions of one text beside each other, repeated rows, pages without address or text
    rows += [(200 + k, f"https://hot.example/en/5{k}", rows[1][2]) for k in range(12)]
    rows += [rows[5], rows[5], (None, None, rows[4][2]), (None, rows[3][1], rows[3][2]), (307, "", ""), (308, "https://alone.example/x", None), (309, "https://alone.example/", _template("alone", "<p>only one</p>"))]
    got = html_diff.main_text(_pages(spark, rows)).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.url or "", r.text) for r in got) == _brute(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got if r.page_id is not None and r.text}
    assert not any("Home" in texts[k] or "Welcome" in texts[k] for k in range(120))
    assert any("page 49" in t for t in texts.values())
    # copies beside each other look past their like, and keep the text itself
    assert texts[206].split("\n") == re.findall("<p>(.*?)</p>", rows[1][2])


def test_same_pages_whatever_the_number_of_ranges(spark):
    rows = [(k, f"http://one.example/{k % 5}/{k}", _template("one", f"<p>text number {k} of them</p>")) for k in range(60)]
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(tuple(sorted((r.page_id, r.text) for r in html_diff.main_text(_pages(spark, rows)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1 and dict(seen.pop())[7] == "text number 7 of them"


def test_pages_of_an_empty_table_and_extra_columns(spark):
    assert html_diff.main_text(_pages(spark, [])).collect() == []
    clashing = _pages(spark, [(1, "http://a/b", "<p>x</p>")]).select("*", F.lit(1).alias("gone"), F.lit(2).alias("content"), F.lit(3).alias("meta.x"))
    assert [r.text for r in html_diff.main_text(clashing).collect()] == ["x"]


def test_articles_of_the_table(spark):
    """Every page of the table marks its article, and that is what stays."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op11_page_differencing(spark, SF).collect()
    assert len(got) == len(pages)
    import html

    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x)


# ---------------------------------------------------------------- op12


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 18])
def test_line_ends_are_the_pattern_s(piece):
    for text in ("", "\n", "a", "a\nb", "\n\nx\n", "é𝒳\n\r\nq\x00", "long line " * 20 + "\n" + "no end"):
        assert fim.unit_ends(text, piece=piece) == [m.end() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]


def test_fill_in_middle_by_hand_and_back(spark):
    texts = ["", "one", "a\nb\nc", "x <P> y\nz", None, "line\n" * 300, "é\n\n𝒳"]
    rows = [(k % 5 if k < 30 else None, texts[k % 7]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = []
    for i, t in rows:
        t = t or ""
        h = hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or "<P>" in t:
            want.append((i, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < 50:
            want.append((i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []
    assert {r.form for r in fim.fill_in_middle(docs, fim.FimParams(rate=0)).collect()} == {"plain"}


# ---------------------------------------------------------------- op13


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _groups(rows, slips=None, least=3):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}
    near = {w: [x for x in n if _near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def _collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_halves_find_what_all_pairs_find(spark):
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.randrange(4, 9))) for _ in range(250)} | {"x" * 70, "x" * 71, "x" * 69 + "y", "ab" * 40, "ab" * 39 + "b", "aaaaa", "aaaaaa"}
    rows = [(k, " ".join(w.upper() if k % 2 else w for w in draw.choices(sorted(words), k=60))) for k in range(60)]
    rows += [(None, "hello hello World-world world HELLO hellо"), (1, None), (2, ""), (3, rows[0][1]), (3, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("x.y", F.lit(1))
    want = _groups(rows)
    assert any(f for _, f, *_ in want) and max(k for *_, k, _ in want) > 10
    assert _collected(spelling.spelling_groups(docs)) == want
    # words of one segment dealt in many parts and shards
    assert _collected(spelling.spelling_groups(docs, spelling.SpellingParams(bucket=4, shard_rows=50))) == want
    assert _collected(spelling.spelling_groups(docs, spelling.SpellingParams(slips=3))) == _groups(rows, 3)
    assert spelling.spelling_groups(docs.limit(0)).collect() == []


def test_chains_end_in_one_root(spark):
    chain = [("w" + "a" * k, 2**k) for k in range(5, 16)]
    forms = spark.createDataFrame([(w, chain[k + 1][0] if k + 1 < len(chain) else None) for k, (w, _) in enumerate(chain)] + [("alone", None)], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain} | {"alone": "alone"}


def test_words_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = _collected(queries.op13_spelling_groups(spark, SF))
    counts = {w: n for w, _, _, n, _, _ in got}
    # near words from deletions, as another way
    by_cut = collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_cut[w[:i] + w[i + 1 :]].add(w)
    for w, form, _, n, n_near, form_n in got:
        near = set(by_cut.get(w, ())) | {w[:i] + w[i + 1 :] for i in range(len(w))} & counts.keys()
        for i in range(len(w)):
            near |= {x for x in by_cut[w[:i] + w[i + 1 :]] if _near(w, x)}
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        fits = best is not None and counts[best] >= 2 * n
        assert (n_near, form, form_n) == (len(near), best if fits else None, counts[best] if fits else None)
    brute = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{w}".encode())
            brute[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    assert counts == {w: c for w, c in brute.items() if len(w) >= 5 and c >= 3}
