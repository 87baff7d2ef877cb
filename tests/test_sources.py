import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import schema
from folio.functions import text as T
from folio.operators import dml
from folio.sources import epub, files, html, json_import


@pytest.fixture(autouse=True)
def java_charsets(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    yield
    spark.conf.unset("spark.sql.legacy.javaCharsets")


def make_epub(spine=("a", "b"), extra="", package="OEBPS/content.opf"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<container xmlns="u"><rootfiles><rootfile full-path="{package}"/></rootfiles></container>')
        refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
        z.writestr(
            "OEBPS/content.opf",
            '<package xmlns="o" xmlns:dc="d"><metadata><dc:title>My Book</dc:title><dc:creator>Ann</dc:creator></metadata><manifest>'
            '<item id="a" href="Text/a.xhtml"/><item id="b" href="text/B.xhtml#x"/><item id="p" href="p.png"/></manifest>'
            f"<spine>{refs}</spine></package>",
        )
        z.writestr("OEBPS/Text/a.xhtml", "<html><head><title>T</title></head><body><h1> One </h1><p>first&amp;</p><p>second</p></body></html>")
        z.writestr("OEBPS/text/b.xhtml", "<html><body><h1> </h1><h2>Two</h2><div>third</div></body></html>" + extra)
    return out.getvalue()


def test_epub():
    name, author, found = epub.parse(make_epub(("a", "b", "a", "missing")))
    assert (name, author) == ("My Book", "Ann")
    assert found == [("One", "One\nfirst&\nsecond"), ("Two", "Two\nthird")]
    assert epub.parse(make_epub(package="other.opf"))[2] == found  # a container that points nowhere
    for bad in (b"no zip", make_epub(())):
        with pytest.raises(epub.EpubError):
            epub.parse(bad)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def package(items, spine):
    listed = "".join(f'<item id="{i}" href="{h}" media-type="{m}"/>' for i, h, m in items)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
    return f'<package xmlns="o"><metadata><title>N</title></metadata><manifest>{listed}</manifest><spine>{refs}</spine></package>'


PAGE = "application/xhtml+xml"


@pytest.mark.parametrize(
    "members, chapters",
    [
        ({"OEBPS/content.opf": package([("a", "a.xhtml", PAGE)], "a"), "OEBPS/a.xhtml": "<h1>A</h1>x"}, [("A", "A\nx")]),  # no container
        ({"META-INF/container.xml": "<broken", "x/Content.OPF": package([("a", "a.xhtml", PAGE)], "a"), "x/a.xhtml": "<h1>A</h1>x"}, [("A", "A\nx")]),
        ({"OEBPS/content.opf": package([("a", "/OEBPS/Text/a.xhtml", PAGE)], "a"), "OEBPS/Text/a.xhtml": "<h1>A</h1>x"}, [("A", "A\nx")]),  # absolute
        ({"OEBPS/content.opf": package([("a", "other/a.xhtml", PAGE)], "a"), "OEBPS/Text/A.xhtml": "<h1>A</h1>x"}, [("A", "A\nx")]),  # by base name
        ({"OEBPS/content.opf": package([("a", "a.xhtml", PAGE)], "a"), "OEBPS/a.xhtml": "<h1>第一章</h1>中文".encode("gbk")}, [("第一章", "第一章\n中文")]),
        ({"OEBPS/content.opf": package([("s", "s.svg", "image/svg+xml"), ("a", "a.htm", "x")], "sa"), "OEBPS/s.svg": "<svg>t</svg>pic", "OEBPS/a.htm": "x"}, [("a", "x")]),
    ],
)
def test_epub_in_odd_shapes(members, chapters):
    assert epub.parse(zipped(members)) == ("N", "", chapters)


def test_contents_from_cache_chapters_or_file(spark, tmp_path):
    (tmp_path / "novel.txt").write_text("第一章 起\n甲\n第二章 承\n乙\n")
    scanned = files.scan(spark, str(tmp_path))
    path = scanned.first()["path"]
    books = spark.createDataFrame([("a", path), ("b", path), ("c", path), ("d", None)], "book_url string, local_file string")
    tocs = spark.createDataFrame([("a", '[{"title":"T","url":"u","isVolume":false,"index":0}]'), ("b", "[{"), ("c", "")], "book_url string, chapters_json string")
    chapters = spark.createDataFrame([("b", 1, "two"), ("b", 0, "one")], "book_url string, chapter_index long, title string")
    found = {r["book_url"]: r for r in files.resolved_contents(books, tocs, chapters, scanned).collect()}
    assert {i: (r["source"], [x["title"] for x in r["contents"] or ()]) for i, r in found.items()} == {
        "a": ("cache", ["T"]), "b": ("chapters", ["one", "two"]), "c": ("file", ["第一章 起", "第二章 承"]), "d": (None, []),
    }
    assert [x["url"] for x in found["c"]["contents"]] == ["c@0", "c@1"]


def test_store(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("line\nline")
    root = str(tmp_path / "in")
    assert files.stored_text(spark, root, "/sub/../a.txt").first()["value"] == "line\nline"
    for bad in ("../x", "sub/../../x", "/../x"):
        with pytest.raises(ValueError):
            files.confined(root, bad)
    assert sorted((r["path"].rpartition("/")[2], r["is_folder"], r["is_folder"] or r["length"]) for r in files.children(spark, root).collect()) == [("a.txt", False, 9), ("in", True, True), ("sub", True, True)]
    assert files.children(spark, root, 0).count() == 1 and files.children(spark, root + "/none").count() == 0
    files.stored(files.scan(spark, root), str(tmp_path / "raw"), "ann")
    row = spark.read.parquet(str(tmp_path / "raw")).first()
    assert (row["user_namespace"], row["name"], bytes(row["content"])) == ("ann", "a.txt", b"line\nline")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-03"):
        dml.snapshot(spark.range(3), str(tmp_path / "days"), day)
    assert dml.pruned(spark, str(tmp_path / "days"), 2) == ["2024-01-03", "2024-01-02"]
    assert sorted(p.name for p in (tmp_path / "days").iterdir()) == ["2024-01-02", "2024-01-03"]
    assert dml.copied(spark, root, str(tmp_path / "copy")) and (tmp_path / "copy" / "a.txt").exists()
    assert not dml.copied(spark, root + "/none", str(tmp_path / "copy2"))


@pytest.mark.parametrize(
    "source, name, chapters",
    [
        ("<title>N</title><body><h1>A</h1><p>x</p><p>y</p><h2>B</h2><p>z</p></body>", "N", [("A", "x\ny"), ("B", "z")]),
        ("<body><p>x</p><p>y</p></body>", "stem", [("全文", "x\ny")]),
        ("<body>pre<h1>A</h1>x</body>", "stem", [("全文", "pre"), ("A", "x")]),
        ("<body><h1>A</h1>x<h2>B</h2><h2>C</h2>y<h2>D</h2></body>", "stem", [("A", "x"), ("B", ""), ("C", "y")]),
        ("<body><h1>A</h1><h2>B</h2>y</body>", "stem", [("B", "y")]),
        ("<head><title> </title></head><body></body>", "stem", [("全文", "")]),
        ("<body>a&lt;b<script>s</script></body>", "stem", [("全文", "a<bs")]),
    ],
)
def test_html(source, name, chapters):
    assert html.parse(source, "stem") == (name, chapters)


@pytest.mark.parametrize(
    "data, text, charset",
    [
        ("第一章 你好".encode(), "第一章 你好", "utf-8"),
        (b"\xef\xbb\xbf" + "é".encode(), "é", "utf-8"),
        ("第一章 中文".encode("gbk"), "第一章 中文", "gbk"),
        (b"\x84\x31\x95\x33" + "中文".encode("gb18030"), "中文", "gb18030"),
        (b"\xff\xfe" + "aé中".encode("utf-16le"), "aé中", "utf-16le"),
        (b"\xfe\xff" + "aé中".encode("utf-16be"), "aé中", "utf-16be"),
        (b"", "", "utf-8"),
    ],
)
def test_decode(spark, data, text, charset):
    row = spark.createDataFrame([(bytearray(data),)], "c binary").select(T.decoded(F.col("c")).alias("d")).first()["d"]
    assert (row["text"], row["charset"]) == (text, charset)


def test_files(spark, tmp_path):
    (tmp_path / "novel.txt").write_bytes("序\n\n第一章 起\n\n甲\n第二章 承\n乙\n".encode("gbk"))
    (tmp_path / "page.html").write_text("<title>P</title><body><h1>A</h1>x</body>")
    (tmp_path / "b.epub").write_bytes(make_epub())
    (tmp_path / "bad.epub").write_bytes(b"zip?")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    found = {r["path"].rpartition("/")[2]: r for r in files.books(files.scan(spark, str(tmp_path))).collect()}
    novel = found["novel.txt"]
    assert (novel["name"], novel["charset"], novel["error"]) == ("novel", "gbk", None)
    assert [tuple(c) for c in novel["chapters"]] == [("第一章 起", "序\n\n甲\n"), ("第二章 承", "乙\n\n")]
    assert found["page.html"]["name"] == "P" and found["b.epub"]["author"] == "Ann"
    assert found["bad.epub"]["error"] and found["bad.epub"]["chapters"] is None
    assert found["x.pdf"]["error"] == "unsupported format: .pdf"
    shelf, chapters, tocs = files.imported(files.scan(spark, str(tmp_path)), "ann")
    assert {r["total_chapter_num"] for r in shelf.collect()} == {1, 2}
    assert chapters.count() == 5
    toc = tocs.select(F.from_json("chapters_json", schema.TOC).alias("t")).select(F.explode("t.url").alias("u"))
    assert toc.where(T.parsed_chapter_url(F.col("u")).getField("chapter_index") >= 0).count() == 5
    assert files.listing(spark, str(tmp_path)).count() == 5


def test_json_import(spark, tmp_path):
    person = {"username": "alice", "token": "t", "book_limit": 3}
    (tmp_path / "list.json").write_text(json.dumps([person, {"token": "none"}]))
    (tmp_path / "map.json").write_text(json.dumps({"alice": person}))
    for name in ("list", "map"):
        assert [(r["username"], r["book_limit"]) for r in json_import.users(spark, str(tmp_path / f"{name}.json"), schema.TABLES["users"]).collect()] == [("alice", 3)]
    for ns in ("a", "b"):
        (tmp_path / "data" / ns).mkdir(parents=True)
        (tmp_path / "data" / ns / "bookmark.json").write_text(json.dumps([{"book_url": "u", "title": ns}, {"title": "x"}]))
    rows = json_import.namespaces(spark, str(tmp_path / "data"), "bookmark", schema.TABLES["bookmarks"])
    assert {(r["user_namespace"], r["title"]) for r in json_import.string_rules(rows, "book_url").collect()} == {("a", "a"), ("b", "b")}
    c = spark.createDataFrame([('{"config": {"a": "1"}}',), ('{"b": "2"}',)], "c string").select(json_import.config_values(F.col("c")).alias("c"))
    assert [json.loads(r["c"]) for r in c.collect()] == [{"a": "1"}, {"b": "2"}]
