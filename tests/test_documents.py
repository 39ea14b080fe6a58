"""Documents of a tree and their sections, line by line."""

import random
import re

from loomquery.operators import documents


def _direct(path, text, fences=False):
    """Sections by a pass over the lines."""
    if not text.strip():
        return []
    out, title, start, held, fence = [], path.split("/")[-1], 1, [], False
    lines = re.split(r"\r?\n", text)
    for i, line in enumerate(lines):
        if fences and re.match(r"\s*(```|~~~)", line):
            fence = not fence
        head = None if fences and (fence or re.match(r"\s*(```|~~~)", line)) else re.match(r"#{1,4}\s+(.+)$", line)
        if head:
            if held:
                out.append((title, start, max(start, i), " ".join(held)))
            title, start, held = head[1].strip(), i + 1, []
        elif line.strip():
            held.append(line.strip())
    if held or not out:
        out.append((title, start, len(lines), " ".join(held)))
    return out


def test_sections_of_markdown(spark):
    rng, rows = random.Random(3), []
    pieces = ["# A", "## B b ", "#x", "##### no", "text  here", "", "  ", "\ttab", "```", "# in code", "####  D", "#  ", "\r"]
    for i in range(150):
        rows.append((f"d/{i}.md", "md", "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))))
    rows += [("x.md", "md", None), ("y.md", "md", " \n "), ("z.md", "md", "# only"), ("long.md", "md", "# T\n" + "word " * 100)]
    docs = spark.createDataFrame(rows, "path string, format string, content string")
    for fences in (False, True):
        got = {}
        for r in documents.sections(docs, fences).orderBy("path", "n").collect():
            got.setdefault(r["path"], []).append((r["title"], r["start_line"], r["end_line"], r["summary"]))
            assert r["n"] == len(got[r["path"]]) and r["text"].startswith(r["title"])
        want = {p: [(t, a, b, re.sub(r"\s+", " ", s)[:220]) for t, a, b, s in _direct(p, c, fences)] for p, _, c in rows if c and _direct(p, c, fences)}
        assert {p: s for p, s in got.items() if p != "long.md"} == {p: s for p, s in want.items() if p != "long.md"}
        assert len(got["long.md"][0][3]) == 220


def test_marked_html_and_xml(spark):
    html = "<script>x # y</script><h2 class='a'>One &amp; two</h2><p>a</p><STYLE>q</STYLE><h5>no</h5>b &lt;c&gt;"
    xml = '<root>\n <item id="a1" name="b">x &amp; y</item>\n\n <other/>\n</root>'
    rows = spark.createDataFrame([("a.html", "html", html), ("b.xml", "xml", xml)], "path string, format string, content string")
    got = [(r["path"], r["title"], r["summary"]) for r in documents.sections(rows).orderBy("path", "n").collect()]
    assert got == [("a.html", "One & two", "a no b <c>"), ("b.xml", "item: b", "x & y")]


def test_scan_of_a_tree(spark, tmp_path):
    files = {
        "a.md": "# A", "b/c.HTML": "<h1>x</h1>", "b/d.txt": "no", "node_modules/e.md": "no", "b/.hidden/f.md": "no", ".g.md": "no", "sub/h.md": "no", "sub/deep/i.md": "no", "1/2/3/4/5/6/j.xml": "<a/>",
        "1/2/3/4/5/6/7/k.md": "no", "big.md": "x" * 5_000_001, "target/l.md": "no", "targets/m.markdown": "y",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub" / ".git").write_text("gitdir: x")
    got = [(r["path"], r["format"], r["content"]) for r in documents.scan(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == [("1/2/3/4/5/6/j.xml", "xml", "<a/>"), ("a.md", "md", "# A"), ("b/c.HTML", "html", "<h1>x</h1>"), ("targets/m.markdown", "md", "y")]
    assert documents.scan(spark, str(tmp_path), 2).count() == 2
