import os
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle

from quillframe.cli import main
from quillframe.engine import Documents, Records
from quillframe.sources import languages
from quillframe.sources.documents import Options
from quillframe.sources.headers import HeaderError, dump_fields, load_fields, parse, render
from quillframe.sources.listing import SourceError, expand, regex

CASES = {
    "note.md": ("---\nb: x\na: 1\n---\nBody\n", "---\na: 1\nb: x\nnew: 2\n---\nBody\n"),
    "crlf.md": ("---\r\na: 1\r\n---\r\nBody\r\n", "---\r\na: 1\r\nnew: 2\r\n---\r\nBody\r\n"),
    "run.py": ("#!/usr/bin/env python\n# ---\n# a: 1\n# ---\nprint()\n", "#!/usr/bin/env python\n# ---\n# a: 1\n# new: 2\n# ---\nprint()\n"),
    "doc.py": ('"""---\na: 1\n---"""\n', '"""---\na: 1\nnew: 2\n---"""\n'),
    "begin.rb": ("=begin\n---\na: 1\n---\n=end\nputs 1\n", "=begin\n---\na: 1\nnew: 2\n---\n=end\nputs 1\n"),
    "block.js": ("/*---\na: 1\n---*/\nlet x\n", "/*---\na: 1\nnew: 2\n---*/\nlet x\n"),
    "query.sql": ("select 1;\n-- ---\n-- a: 1\n-- ---\n", "select 1;\n-- ---\n-- a: 1\n-- new: 2\n-- ---\n"),
    "separator.sh": ("# ---\n# not yaml: : :\n# ---\n# ---\n# a: 1\n# ---\n", None),
    "empty.md": ("", "---\nnew: 2\n---\n"),
    "none.md": ("Text\n---\na: 1\n---\n", "---\nnew: 2\n---\nText\n---\na: 1\n---\n"),
    "none.css": ("a{}\n", "/*---\nnew: 2\n---*/\na{}\n"),
    "none.py": ("#!/usr/bin/python\n# -*- coding: utf-8 -*-\nx = 1\n", "#!/usr/bin/python\n# -*- coding: utf-8 -*-\n# ---\nnew: 2\n".replace("new", "# new") + "# ---\nx = 1\n"),
    "open.md": ("---\na: 1\n", "---\nnew: 2\n---\n---\na: 1\n"),
}


@pytest.mark.parametrize("name", CASES)
def test_headers_are_rewritten_and_nothing_else(name):
    before, after = CASES[name]
    document = parse(name, before)
    if after is not None:
        assert render(document, {**document.fields, "new": 2}) == after
    # What is not found is not changed either.
    assert parse(name, render(document, document.fields)).fields == document.fields


def test_yaml_of_headers():
    text = "b: yes\nn: 010\nf: 1.50\nt: 2024-01-02\nm: 2024-01-02T03:04:05Z\nl: [a, 1, ~]\ns: 'true'\nx: 0x1F\n"
    fields = load_fields(text)
    assert fields["b"] == "yes" and fields["n"] == 8 and fields["x"] == 31 and fields["t"] == datetime(2024, 1, 2) and fields["l"] == ["a", 1, None]
    out = dump_fields({"a10": 1, "a2": "true", "y": "no", "t": datetime(2024, 1, 2), "l": ["x", "y: z"], "long": "a\nb"})
    assert out == "a2: \"true\"\na10: 1\nl:\n  - x\n  - 'y: z'\nlong: |-\n  a\n  b\nt: 2024-01-02\ny: no\n"
    assert load_fields(out)["a2"] == "true"
    with pytest.raises(HeaderError):
        load_fields("a: 1\na: 2")
    with pytest.raises(HeaderError):
        parse("bad.md", "---\n: : [\n---\n")


def test_languages():
    assert languages.language_of("x.TSX", "").name == "c" and languages.language_of("run", "#!/usr/bin/env -S python3.12 -u\n").name == "python" and languages.language_of("README", "").name == "markdown"
    assert languages.chosen("py").name == "python" and languages.chosen(block_open="<<").block == (("<<", "<<"),) and languages.chosen() is None
    for bad in ({"lang": "klingon"}, {"lang": "py", "line_comment": "#"}, {"block_close": "x"}):
        with pytest.raises(languages.SyntaxChoiceError):
            languages.chosen(**bad)


@pytest.fixture
def folder(tmp_path, monkeypatch):
    files = {
        "a.md": "---\ntitle: Alpha\nrating: 3\ntags: x\n---\nA\n",
        "b.md": "---\ntitle: Beta\nrating: 10\nextra: yes\n---\n",
        "c.md": "no header\n",
        ".hidden.md": "---\ntitle: Secret\n---\n",
        "tool.sh": "#!/bin/sh\necho\n",
        "blob.png": "\0\1",
        "data.txt": "---\ntitle: Text\n---\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_listing(folder):
    assert expand(["*"]) == ["a.md", "b.md", "c.md", "tool.sh"]
    assert expand(["*.*"]) == ["a.md", "b.md", "blob.png", "c.md", "data.txt", "tool.sh"]
    assert expand(["*"], include_hidden=True)[0] == ".hidden.md" and expand([".hidden.md"]) == [".hidden.md"]
    with pytest.raises(SourceError):
        expand(["missing.md"])


def test_select(spark, folder):
    out = Documents(spark).run("select title, rating from *.md where rating > 1 sort by rating desc; select from * where title; select * from *.md")
    assert out.results[0].rows == [["b.md", "Beta", "10"], ["a.md", "Alpha", "3"]]
    assert [r[0] for r in out.results[1].rows] == ["a.md", "b.md"]
    assert out.results[2].headers == ["filename", "extra", "rating", "tags", "title"] and out.ok


def test_sort_puts_nulls_where_they_belong(spark, folder):
    out = Documents(spark).run("select rating from *.md sort by rating; select rating from *.md sort by rating desc; select from *.md limit 2")
    assert [[r[0][0] for r in t.rows] for t in out.results] == [["a", "b", "c"], ["c", "b", "a"], ["a", "b"]]


def test_updates_are_written_once_and_errors_stay_with_their_file(spark, folder):
    out = Documents(spark, Options(verbose=True)).run("update *.md set tags += 'y', n:int = rating; select tags from *.md; alter *.md rename title to name")
    assert out.errors == [("c.md", 'cannot cast value to int for field "n": cannot cast null')]
    assert (folder / "a.md").read_text() == "---\nn: 3\nname: Alpha\nrating: 3\ntags:\n  - x\n  - y\n---\nA\n"
    assert (folder / "c.md").read_text() == "no header\n"
    assert out.results[1].rows == [["a.md", "[x, y]"], ["b.md", "[y]"]]
    assert sorted(out.changed) == ["a.md", "b.md"]


def test_new_headers_need_a_name_or_markdown(spark, folder):
    out = Documents(spark).run("update * set a = 1")
    assert out.errors == [("tool.sh", "could not write: no header; name the file explicitly or pass --lang to insert one")]
    assert (folder / "c.md").read_text() == "---\na: 1\n---\nno header\n"
    assert Documents(spark).run("update tool.sh set a = 1").ok
    assert (folder / "tool.sh").read_text() == "#!/bin/sh\n# ---\n# a: 1\n# ---\necho\n"
    assert Documents(spark).run("select from blob.png").errors == [("blob.png", "could not read: not a text file")]


def test_dry_run_and_rendered(spark, folder):
    before = (folder / "a.md").read_text()
    assert Documents(spark, Options(dry_run=True)).run("update a.md set rating = 4").ok and (folder / "a.md").read_text() == before
    rows = Documents(spark).rendered("update a.md set rating = 4").collect()
    assert [(r.path, "rating: 4" in r.content) for r in rows] == [("a.md", True)] and (folder / "a.md").read_text() == before


def test_documents_of_a_table(spark):
    files = {"a/x.md": "---\nn: 2\n---\n", "a/y.py": "# ---\n# n: 1\n# ---\n", "a/.z.md": "---\nn: 9\n---\n", "b/x.md": "---\nn: 5\n---\nB\n", "a/t.txt": "---\nn: 7\n---\n", "a/s.sh": "echo\n"}
    content = spark.createDataFrame([(k, v.encode()) for k, v in files.items()] + [("a/null.md", None)], "path string, content binary")
    documents = Documents(spark, content=content)
    assert [tuple(r) for r in documents.query("select n, n + 1 from a/* where n sort by n").collect()] == [("a/y.py", "1", "2"), ("a/x.md", "2", "3")]
    assert [r.filename for r in documents.query("select from b/x.md a/*.md a/.z.md").collect()] == ["b/x.md", "a/.z.md", "a/null.md", "a/x.md"]
    assert [r.fields for r in documents.query("select * from */x.md").collect()] == [{"n": "2"}, {"n": "5"}]
    out = documents.run("update a/* b/[!y].m? set m = n; select m from b/*")
    assert out.results[1].rows == [["b/x.md", "5"]] and [p for p, _ in out.errors] == ["a/s.sh"] and sorted(out.changed) == ["a/null.md", "a/x.md", "a/y.py", "b/x.md"]
    assert {r.path: r.content for r in documents.rendered("update */x.md set m = 1 where n > 2").collect()} == {"b/x.md": "---\nm: 1\nn: 5\n---\nB\n"}


def test_patterns_of_paths():
    import fnmatch
    import re

    for pattern in ("*.md", "a?c*", "[ab]*.x", "[!a]*", "x[^-&]y", "a.b+c", "[]a]b", "**"):
        for path in ("x.md", "abc", "abcd", "b.x", "c.x", "x&y", "x-y", "x.y", "a.b+c", "aXb+c", "]b", "ab"):
            assert bool(re.match(regex(pattern).replace(r"\z", r"\Z"), path)) == fnmatch.fnmatchcase(path, pattern.replace("[^", "[!")), (pattern, path)
    assert not re.match(regex("*").replace(r"\z", r"\Z"), "a/b")


def test_query_gives_a_frame(spark, folder):
    rows = Documents(spark).query("select title, rating from *.md where title").collect()
    assert [tuple(r) for r in rows] == [("a.md", "Alpha", "3"), ("b.md", "Beta", "10")]


def test_command_line(spark, folder, capsys):
    assert main(["select title from a.md", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out == "filename,title\na.md,Alpha\n(1 row)\n"
    assert main(["select * from *.md", "--format", "simple", "--max-columns", "1"], spark) == 0
    assert capsys.readouterr().out == "filename  extra\n--------  -----\na.md      \nb.md      yes\nc.md      \n(3 rows)\n(3 more column(s) hidden; raise --max-columns to show)\n"
    assert main(["select a from x where a === 1"], spark) == 2 and "parse: unexpected character '='" in capsys.readouterr().err
    assert main(["  "], spark) == 2 and main(["select a from a.md", "--format", "odd"], spark) == 2 and main(["select a from missing.md"], spark) == 1
    assert main(["update * set z = 1", "-d", "-s"], spark) == 0 and os.path.exists("a.md")
    assert main(["select title from *", "-L", "shell", "--format", "md"], spark) == 1  # a binary file is found too
    assert "| a.md |  |" in capsys.readouterr().out


# Tasks can't import this module, so its class is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Shelf:
    """A store in a folder of JSON files."""

    def __init__(self, folder):
        self.folder = str(folder)

    def enumerate(self, words, include_hidden):
        return [f"{w}/{n}" for w in words for n in sorted(os.listdir(os.path.join(self.folder, w)))]

    def read(self, key):
        import json

        with open(os.path.join(self.folder, key)) as f:
            return json.load(f)

    def write(self, key, fields):
        import json

        if fields.get("locked"):
            raise ValueError("locked")
        with open(os.path.join(self.folder, key), "w") as f:
            json.dump(fields, f)

    def label(self, key):
        return key.removesuffix(".json")


def test_a_store_of_one_s_own(spark, tmp_path):
    (tmp_path / "box").mkdir()
    for name, text in {"a.json": '{"n": 1}', "b.json": '{"n": 2, "locked": true}', "c.json": "broken"}.items():
        (tmp_path / "box" / name).write_text(text)
    records = Records(spark, Shelf(tmp_path))
    out = records.run("update box set n = n + 10, tags += 'x'; select n, tags from box sort by n desc")
    assert out.results[1].rows == [["box/b", "12", "[x]"], ["box/a", "11", "[x]"]] and out.changed == ["box/a"]
    assert [p for p, _ in out.errors] == ["box/b", "box/c"] and out.errors[0][1] == "could not write: locked"
    assert (tmp_path / "box/a.json").read_text() == '{"n": 11, "tags": ["x"]}'


def test_strictness(spark, folder):
    text = "select 1 + 1, missing from nothing*.md; alter a.md rename title to title; select title from a.md"
    loose, strict = (Documents(spark, Options(dry_run=True, strict=s)).run(text) for s in (False, True))
    assert loose.results[0].rows == [] and loose.results[2].rows == [["a.md", "Alpha"]]
    assert strict.results[0].headers == ["expr1", "missing"] and strict.results[0].rows == [["2", ""]] and strict.results[2].rows == [["a.md", ""]]


def test_documents_are_evaluated_once_whatever_the_order(spark, tmp_path):
    content = spark.range(40).repartition(4).selectExpr("concat('d/', lpad(id, 3, '0'), '.md') AS path", "concat('---\nn: ', id, '\n---\n', repeat('x', 2000)) AS content")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    content = content.mapInArrow(counted, "path string, content string")
    for program, ordered in (("select n from d/*", False), ("select n from d/*", True), ("select n from d/* sort by n desc", True), ("select n from d/* sort by n limit 3", True)):
        read.value = 0
        rows = [r.n for r in Documents(spark, content=content).query(program, ordered=ordered).collect()]
        assert read.value == 40, program
        assert sorted(map(int, rows)) == ([0, 1, 2] if "limit" in program else list(range(40)))


def test_only_headers_leave_the_jvm_where_nothing_changes(spark):
    from quillframe.plans.parser import parse_program
    from quillframe.sources.documents import _needed

    texts = {"a.md": "---\nn: 1\n---\nbody", "b": "---\r\nn: 1\r\n--- \r\nbody", "c.md": "body\n---\nn: 1\n---\n", "d.py": "---\nn: 1\n---\nx", "e.md": "---\nn: 1\n---\nx\0", "f.md": "---\nn: 1\nopen", "g.md": "---\n---\nx", "h.txt": "---\na: ---\nb: 1\n---\nx", "i.md": "---\nn: |\n  ----\nm: 2\n---", "j.md": None}
    content = spark.createDataFrame(list(texts.items()), "path string, content string")
    cut = {r[0]: r[1] for r in content.select("path", _needed(parse_program("select n from *"), content, Options())).collect()}
    assert cut == texts | {"a.md": "---\nn: 1\n---\n", "b": "---\r\nn: 1\r\n--- \r\n", "g.md": "---\n---\n", "h.txt": "---\na: ---\nb: 1\n---\n", "i.md": "---\nn: |\n  ----\nm: 2\n---"}
    for path, text in texts.items():
        if text is not None and "\0" not in text:
            assert parse(path, cut[path]).fields == parse(path, text).fields and parse(path, cut[path]).found == parse(path, text).found
    whole = content.select(_needed(parse_program("update * set n = 1"), content, Options())).collect()
    assert [r[0] for r in whole] == list(texts.values())
