import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import values as V
from folio.operators import chapters, dml, shelf, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def segment(text, rules=()):
    """The segmentation's contract, line by line."""
    import re

    lines = [x.strip() for x in re.sub("\r\n?", "\n", text).split("\n")]
    found, lead = [], []
    for line in lines:
        if any(re.search(r, line) for r in (*rules, T.CHAPTER_TITLE)):
            found.append([line, ""])
        elif found:
            found[-1][1] += line + "\n"
        elif line:
            lead.append(line)
    if not found:
        return [("全文", "\n".join(lead) if lead else text)]
    if lead:
        found[0][1] = "\n".join(lead) + "\n" + found[0][1]
    return [tuple(x) for x in found]


CASES = [
    "第一章 甲\n\nfirst\n第二章 乙\nsecond",
    "preamble\n\n  more \n第1章\nx\n\n\ny\n",
    "\n \n",
    "",
    "no title\n\nat all",
    "第一章\r\n\r\nx\r第二章",
    "　第三回　題　\n　text　",
]


@pytest.mark.parametrize("text", CASES)
def test_segmentation(spark, text):
    rows = chapters.segmented(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chapter_index").collect()
    assert [(r["title"], r["content"]) for r in rows] == segment(text)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["第一章 a", "x", " y ", "", "T z", "\t"]), max_size=8), min_size=1, max_size=12))
def test_segmentation_loses_nothing(spark, texts):
    docs = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    rows = chapters.segmented(spark.createDataFrame(docs, "doc_id long, text string"), ["^T "]).orderBy("doc_id", "chapter_index").collect()
    for i, text in docs:
        assert [(r["title"], r["content"]) for r in rows if r["doc_id"] == i] == segment(text, ["^T "])


def test_bad_rules_are_skipped():
    assert chapters.usable_rules(["(", "", "a" * 200, "a" * 201, "(?=x)", "^x"]) == ["a" * 200, "^x"]


def test_snippets(spark):
    c = F.lit("x" * 40 + "KEY\n" + "y" * 40)
    assert one(spark, T.snippet(c, "key")) == "x" * 30 + "KEY " + "y" * 29
    assert one(spark, T.snippet(c, "none")) is None
    assert one(spark, T.snippet_bytes(F.lit("中" * 20 + "key"), "key")) == "中" * 10 + "key"
    assert one(spark, T.snippet_bytes(F.lit("中" * 10 + "ab" + "key"), "key")).startswith("�")


def test_text_functions(spark):
    assert one(spark, T.trim(F.lit("　  a b\t"))) == "a b"
    assert one(spark, T.occurrences(F.lit("aXaxa.a"), "AXA")) == 1
    assert one(spark, T.occurrences(F.lit("a.b.c"), ".")) == 2
    assert one(spark, T.occurrences(F.lit("e" * 600), "e", 500)) == 500
    assert one(spark, T.replaced(F.lit("abc"), [("a", "b"), ("b", "c"), (" ", "x")])) == "ccc"
    assert one(spark, T.highlighted(F.lit("<a>A"), "a")) == "&lt;<mark>a</mark>&gt;<mark>A</mark>"
    assert one(spark, T.intro_preview(F.lit(""), F.lit(" " + "i" * 130))) == "i" * 120 + "…"
    parsed = one(spark, F.array(*(T.parsed_chapter_url(F.lit(u)) for u in ("a@b@3", "plain", "a@x"))))
    assert [tuple(x) for x in parsed] == [("a@b", 3), ("plain", 0), ("a", None)]
    assert one(spark, T.stem(F.lit("/x/y.z/a.b.txt"))) == "a.b"


def test_scripts(spark):
    characters = "歷史閱讀历史阅读"
    simple, traditional = T.script_table(spark, False, characters), T.script_table(spark, True, characters)
    assert one(spark, T.converted(F.lit("歷史 閱讀"), simple)) == "历史 阅读"
    assert one(spark, T.is_traditional(F.lit("歷史"), simple, traditional))
    assert not one(spark, T.is_traditional(F.lit("历史"), simple, traditional))


def test_values(spark):
    assert [one(spark, V.duration(F.lit(s))) for s in (40, 300, 7500)] == ["40s", "5m", "2h 5m"]
    assert [one(spark, V.file_size(F.lit(s))) for s in (10, 2048, 3 << 20)] == ["10 B", "2.0 KB", "3.0 MB"]
    assert [one(spark, V.fresh(F.lit(0), n)) for n in (300_000, 300_001)] == [True, False]
    assert one(spark, V.is_private(F.lit("172.31.0.1"))) and not one(spark, V.is_private(F.lit("172.32.0.1")))
    assert not one(spark, V.is_private(F.lit("300.1.1.1")))
    assert one(spark, V.luminance(F.lit("#ffffff"))) == pytest.approx(1)
    assert one(spark, V.token_valid(F.lit("b"), F.lit("a"), F.array(F.lit("b")), F.lit(0), 86_400_000, 1))
    assert one(spark, V.position(F.lit(3), F.lit(0.0), F.lit(0))) == 0
    days = F.create_map(F.lit("2024-01-01"), F.lit(5.0), F.lit("2024-01-02"), F.lit(0.0), F.lit("x"), F.lit(1.0))
    assert one(spark, V.valid_days(days)) == {"2024-01-01": 5.0}
    assert one(spark, V.recent_days(days, F.lit("2024-02-01").cast("date"))).get("2024-01-01") == 5.0
    assert "2024-01-01" not in one(spark, V.recent_days(days, F.lit("2024-02-02").cast("date")))


def test_upsert_is_idempotent_and_the_last_wins(spark):
    state = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, created long")
    batch = spark.createDataFrame([("a", 5, 99, 1), ("a", 7, 98, 2), ("c", 3, 30, 3)], "k string, v long, created long, seq long")
    once = dml.upserted(state, batch, ["k"], "seq", keep=("created",))
    twice = dml.upserted(once, batch, ["k"], "seq", keep=("created",))
    expected = [("a", 7, 10), ("b", 2, 20), ("c", 3, 30)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == expected


def test_save_swaps_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        dml.save(spark.range(n).withColumn("ns", F.lit("a")), path, "ns")
        assert spark.read.parquet(path).count() == n
    dml.save(spark.read.parquet(path).where("id = 1"), path, "ns")
    assert spark.read.parquet(path).count() == 1 and len(list(tmp_path.iterdir())) == 1


def test_groups(spark):
    groups = spark.createDataFrame([(1, "x", 1, "n"), (2, "y", 2, "n"), (3, "z", 3, "n")], "id long, name string, order_num long, user_namespace string")
    ids = lambda df: [r["id"] for r in df.orderBy("order_num").collect()]
    assert ids(shelf.moved(groups, 1, 3)) == [2, 3, 1]
    assert ids(shelf.moved(groups, 3, 1)) == [3, 1, 2]
    assert ids(shelf.moved(groups, 9, 1)) == [1, 2, 3]
    assert dml.with_group(groups, "new", 9, "n").where("id = 4").count() == 1
    assert dml.with_group(groups, "new", 9, "n", 2).where("name = 'new'").first()["id"] == 2


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "book_url string, date string, seconds long, chars long")
    assert tuple(stats.reading_windows(empty, "2024-01-30").first()) == (0, 0, 0)
    assert [r["seconds"] for r in stats.dense_days(empty, "2024-01-30").collect()] == [0] * 7


def test_chinese_order(spark):
    rows = spark.createDataFrame([("张",), ("阿",), ("王",), ("李",)], "name string").withColumn("author", F.lit("")).withColumn("book_url", F.lit(""))
    assert [r["name"] for r in rows.orderBy(*shelf.order("name")).collect()] == ["阿", "李", "王", "张"]


def test_sanitised(spark):
    cases = {
        '<a href="javascript:alert(1)">x</a>': "<a>x</a>",
        "<a HREF='javascript:alert(1)'>x</a>": "<a>x</a>",
        "<a href=javascript:alert(1)>x</a>": "<a>x</a>",
        '<img src="data:text/html;base64,PHNj">': "<img>",
        '<a href="&#106;avascript:alert(1)">x</a>': "<a>x</a>",
        '<a href="&amp;#106;avascript:alert(1)">x</a>': "<a>x</a>",
        '<a xlink:href="java\tscript:x" href="https://e.org/?a=1&amp;b">x</a><img src=/a.png>': '<a href="https://e.org/?a=1&amp;b">x</a><img src=/a.png>',
        "a<script>b</script>c<style>d</style><iframe src=x>e</iframe><embed src=x>f<p onclick='x()' class=y>g</p>": "acf<p class=y>g</p>",
        "<p>plain</p>": "<p>plain</p>",
        "": "",
    }
    rows = spark.createDataFrame([*((k, v) for k, v in cases.items()), (None, None)], "source string, clean string")
    for r in rows.select("source", "clean", T.sanitised(F.col("source")).alias("got")).collect():
        assert r["got"] == r["clean"], r["source"]
    c = spark.createDataFrame([("&colon;&sol;&sol;x",), ("&amp;amp;#106;",), ("a&unknown;b",), ("&#x6A;&#1114112;",), (None,)], "c string")
    assert [r["x"] for r in c.select(T.resolved_references(F.col("c")).alias("x")).collect()] == ["://x", "j", "a&unknown;b", "j", None]
    c = spark.createDataFrame([(x,) for x in ("JaVaScRiPt:x", "java script:x", "jav\0ascript:x", "vbscript:x", "https://e.org", "/data:", "")], "c string")
    assert [r["x"] for r in c.select(T.dangerous_url(F.col("c")).alias("x")).collect()] == [True] * 4 + [False] * 3
    c = spark.createDataFrame([("<p>caf&eacute; &mdash; &amp;lt;</p>",)], "c string")
    assert c.select(T.html_text(F.col("c"), every_reference=True).alias("x")).first()["x"] == "café — &lt;"


def test_sanitised_stays_safe(spark):
    """Random nestings of markup, references and separators against a parser of HTML that knows nothing of the function."""
    import random
    from html.parser import HTMLParser

    from folio.functions.text import _resolved, _sanitised

    def once(s):
        s = re.sub("&#x([0-9a-f]+);", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "", s, flags=re.I)
        s = re.sub("&#([0-9]+);", lambda m: chr(int(m[1])) if int(m[1]) < 0x110000 else "", s)
        return re.sub("&([a-zA-Z][a-zA-Z0-9]*);", lambda m: T.URL_ENTITIES.get(m[1], m[0]), s)

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.bad = []

        def handle_starttag(self, tag, attrs):
            for name, value in attrs:
                url = re.sub("[\x00-\x20\x7f]", "", once(once(once(value or "")))).lower()
                if tag in T.UNSAFE_ELEMENTS or name.startswith("on") and value is not None or name in T.LINKS and url.startswith(T.UNSAFE_SCHEMES):
                    self.bad.append((tag, name, value))

    fixed = {
        '<a href="a&#1;&#2;b">x</a><a href="javascript:alert(1)">y</a>': '<a href="a&#1;&#2;b">x</a><a>y</a>',
        '<a href="&#x26;#38;amp;#106;avascript:x">z</a>': "<a>z</a>",
        "one = 1 and on = 2": "one = 1 and on = 2",
        "<a title='x'href=javascript:y>z": "<a title='x'>z",
        "<scr<script>x</script>ipt>y": "<scr<script>xipt>y",
        "a<script>b": "a",
        '<a = href="javascript:x">': "<a =>",
        "1 < 2 <b class=c>": "1 < 2 <b class=c>",
    }
    for source, clean in fixed.items():
        assert _sanitised(source) == clean
    pieces = ["<a ", "<img ", "<script", "</script>", "<form>", "</form>", "<p>", ">", "href=", " src=", " xlink:href = ", " onclick=", '"', "'", "javascript:", "&#106;avascript:", "&amp;#x6A;avascript:", "java\tscript:x", "data:x", "https://e.org/", "&#1;&#2;", "\x01\x02", " ", "/", "=", "on", "text", "&colon;", "&#x26;#38;"]
    rng = random.Random(5)
    for _ in range(5000):
        source = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        walk = Walk()
        walk.feed(_sanitised(source))
        assert not walk.bad, (source, _sanitised(source), walk.bad)
        assert _resolved(source) == once(once(once(source)))
    assert _sanitised("<iframe " * 50_000) == ""
    got = spark.createDataFrame([(k,) for k in fixed], "s string").select("s", T.sanitised("s").alias("t")).collect()
    assert {r["s"]: r["t"] for r in got} == fixed


def test_network_bounds():
    import ipaddress

    nets = ["10.0.0.0/8", "10.1.0.0/16", "11.0.0.0/8", "::/0"]
    assert V.network_bounds(nets) == ["0" * 32] and V.network_bounds(nets[:3]) == [f"{0xFFFF0A000000:032x}", f"{0xFFFF0C000000:032x}"]
    assert V.network_bounds(["ff00::/8"]) == [f"{int(ipaddress.ip_address('ff00::')):032x}"]


def test_rules_of_namespaces(spark):
    rules = [("a", 2, "^B ", 1, 1), ("a", 1, "^A ", 1, 1), ("a", 3, "(", 1, 0), ("a", 4, "^C ", 0, 0), ("b", 1, r"(?P<n>\d+)\.$", 1, 0), ("b", 2, r"^\p{Han}[[:digit:]]+", 1, 1), ("c", 1, "(?=x)", 1, 0), ("c", 2, None, 1, 0), ("c", 3, " ", 1, 0), ("c", 4, "y" * 201, 1, 0), ("c", 5, r"\p{Nope}", 1, 0)]
    table = spark.createDataFrame(rules, "user_namespace string, id long, rule string, enable int, serial_number long")
    usable = {(r["user_namespace"], r["id"]): r["usable"] for r in chapters.checked_rules(table).collect()}
    assert usable == {(ns, i): (ns, i) in {("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2)} for ns, i, *_ in rules}
    own = {r["user_namespace"]: r["__rules"] for r in chapters.namespace_rules(table).collect()}
    assert own["a"] == ["^A ", "^B "] and len(own["b"]) == 2 and "c" not in own
    text = "A one\nB two\nC three\n17.\n中5 x\n第1章 四\nend"
    docs = spark.createDataFrame([(1, text, "a", 0), (2, text, "b", 0), (3, text, "c", 0), (4, text, None, 0), (5, None, "a", 0)], "doc_id long, text string, user_namespace string, __rules int")
    got = {}
    for r in chapters.segmented(docs, table).orderBy("doc_id", "chapter_index").collect():
        got.setdefault(r["doc_id"], []).append(r["title"])
    assert got == {1: ["A one", "B two", "第1章 四"], 2: ["17.", "中5 x", "第1章 四"], 3: ["第1章 四"], 4: ["第1章 四"]}
    plain = {r["doc_id"]: [c["title"] for c in r["chapters"]] if r["chapters"] else None for r in chapters.segments(docs, table).collect()}
    assert plain == got | {5: None}


def test_namespace_of_most_texts(spark, tmp_path):
    """Nearly all texts in one namespace: few rules move no text, and otherwise no task gets the namespace whole."""
    spark.range(4000).selectExpr("id as doc_id", "concat('A ', id, '\nB ', id, '\n', repeat(sha2(string(id), 512), 40)) as text", "if(id % 100 = 0, 'b', 'a') as user_namespace").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    table = spark.createDataFrame([("a", 1, "^A ", 1, 1), ("b", 2, "^B ", 1, 1)], "user_namespace string, id long, rule string, enable int, serial_number long")
    want = {(i, ("B " if i % 100 == 0 else "A ") + str(i)) for i in range(4000)}
    few = chapters.segmented(docs, table, few=True)
    assert {(r["doc_id"], r["title"]) for r in few.collect()} == want
    texts_dealt = [line for line in few._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line and "doc_id" in line]
    assert not texts_dealt
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = chapters.segmented(docs, table).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["title"]) for r in rows} == want and len(rows) == len(want)
    tasks = [r["task"] for r in rows]
    assert max(tasks.count(t) for t in set(tasks)) < 2000


def test_addresses(spark):
    known = {"::1": True, "fe80::1": True, "FD00:1:2::3": True, "ff02::1": True, "::": True, "::ffff:10.1.2.3": True, "::ffff:8.8.8.8": False, "2001:db8::1": False, "2001:db8:0:0:0:0:0:1": False}
    known |= {"1::2::3": False, "12345::1": False, "10.0.0.1": True, "239.1.1.1": True, "0.0.0.0": True, "8.8.8.8": False, "1:2:3:4:5:6:7": False, "x": False, ":1": False}
    rows = spark.createDataFrame([(k,) for k in known], "a string")
    got = {r["a"]: (r["p"], r["six"]) for r in rows.select("a", V.is_private(F.col("a")).alias("p"), V.ipv6(F.col("a")).alias("six")).collect()}
    assert {k: p for k, (p, _) in got.items()} == known
    import ipaddress

    for k, (_, six) in got.items():
        try:
            want = f"{int(ipaddress.IPv6Address(k)):032x}"
        except ValueError:
            want = None
        assert six == want, k
    inside = rows.select("a", V.in_network6(F.col("a"), "2001:db8::/31").alias("i")).where("i").collect()
    assert {r["a"] for r in inside} == {"2001:db8::1", "2001:db8:0:0:0:0:0:1"}


def test_random_ids(spark):
    r = spark.range(50).select(V.new_id().alias("i"), V.new_token().alias("t")).collect()
    assert len({x["i"] for x in r}) == 50 and all(x["i"][14] == "4" and len(x["t"]) == 32 for x in r)


def test_snippets_in_bytes(spark):
    texts = ["é" * 40 + " the " + "中" * 20 + "\nx", "The end", "x" * 29 + "ü the" + "ü" * 20, "none", "ab THE\U0001f600" + "y" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.snippet_bytes(F.col("t"), "The").alias("s")).collect()
    for text, r in zip(texts, got):
        data, at = text.encode(), text.lower().encode().find(b"the")
        if at < 0:
            assert r["s"] is None
            continue
        cut = data[max(0, at - 30) : at + 33]
        # one U+FFFD may stand for one byte or for the rest of a character
        want = cut.decode("utf-8", "replace").replace("\n", " ")
        assert r["s"].strip("\ufffd") == want.strip("\ufffd")


def test_groups_renumber_by_namespace(spark):
    rows = spark.createDataFrame([(i, i, ns) for ns in "ab" for i in range(1, 5)], "id long, order_num long, user_namespace string")
    got = shelf.moved(rows.where("user_namespace = 'a' or id < 3"), 4, 1).collect()
    assert {(r["user_namespace"], r["id"]): r["order_num"] for r in got} == {("a", 4): 1, ("a", 1): 2, ("a", 2): 3, ("a", 3): 4, ("b", 1): 1, ("b", 2): 2}


def test_places_over_ranges(spark):
    """A section of nearly all rows, small ones, and null keys, dealt to many ranges."""
    import random

    rng = random.Random(2)
    rows = [(7 if k % 10 else k % 3, rng.choice([None, f"n{rng.randint(0, 40):03}"]), k) for k in range(900)] + [(None, "x", 9000), (None, "w", 9001)]
    got = shelf.placed(spark.createDataFrame(rows, "section long, name string, url long").repartition(5), "section", "name", "url")
    assert got.columns == ["section", "name", "url", "place"]
    want = []
    for section in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == section), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want += [(*r, n) for n, r in enumerate(own, 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert shelf.placed(spark.createDataFrame([], "section long, name string, url long"), "section", "name", "url").count() == 0


def test_files_of_exported_books(spark, tmp_path):
    chapters_ = [(b, i, f"t{i}", f"line {i}\n\né" * (i % 4)) for b in ("a/b", "c d", "é") for i in range(12)]
    df = spark.createDataFrame(chapters_, "book_url string, chapter_index int, title string, content string").repartition(4)
    dml.export_files(df, str(tmp_path / "out"))
    folders = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) == 3 and all(len(list(p.glob("*.txt"))) == 1 for p in folders)
    want = {r["book_url"]: r["text"] for r in dml.exported(df).collect()}
    back = spark.read.schema("text string, book_url string").text(str(tmp_path / "out"), wholetext=True)
    assert {r["book_url"]: r["text"] for r in back.collect()} == want


def test_exported_texts_come_back_whole(spark, tmp_path):
    """Files that are split among tasks, with breaks and blank lines of all kinds, are put together as they were."""
    from folio.sources import files

    contents = ["", "\n", "a\r\nb\rc\n\n", "é\u2028\U0001f600" * 40, "\n\n x", "line\n" * 300]
    chapters_ = [(b, i, f"t{i}\r", contents[(i + k) % len(contents)]) for k, b in enumerate(("a/b", "c d", "é", "e=f", None)) for i in range(30)]
    df = spark.createDataFrame(chapters_, "book_url string, chapter_index int, title string, content string").repartition(4)
    want = sorted(map(tuple, dml.exported(df).collect()), key=str)
    dml.export_files(df, str(tmp_path / "out"))
    own = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for size, rows in ((own["spark.sql.files.maxPartitionBytes"], 10_000), ("1000b", 7)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            back = files.exported_texts(spark, str(tmp_path / "out"))
            assert back.columns == ["book_url", "text"]
            assert sorted(map(tuple, back.collect()), key=str) == want
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


def test_export_is_not_read_as_whole_texts(spark, tmp_path):
    """The reader of whole texts holds a text five times over and more, which ended on a book of 1 GB."""
    from folio.plans import texts

    spark.createDataFrame([(1, "x", "en", "web"), (2, "y\n", "en", "book"), (3, "", "fr", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = texts.export_files(spark, str(tmp_path))
    assert {r["book_url"]: r["text"] for r in out.collect()} == {"en": "web\n\nx\n\nbook\n\ny\n\n\n", "fr": "web\n\n\n\n"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Sort" in plan


def test_a_book_that_no_row_holds_is_refused(spark, tmp_path, monkeypatch):
    """By its file's size, before it is put together: one of 6 GB took a task's memory first. Lines are sorted as pieces of a batch."""
    from folio.sources import files

    df = spark.createDataFrame([("a", 1, "t", "x" * 7), ("b", 1, "t", "é\n" * 300), ("b", 2, "t", "y")], "book_url string, chapter_index int, title string, content string")
    dml.export_files(df, str(tmp_path / "out"))
    want = {r["book_url"]: r["text"] for r in dml.exported(df).collect()}
    size = len(want["b"].encode())
    monkeypatch.setattr(files, "ROW_BYTES", size, raising=False)
    back = files.exported_texts(spark, str(tmp_path / "out"))
    assert {r["book_url"]: r["text"] for r in back.collect()} == want
    assert back._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    monkeypatch.setattr(files, "ROW_BYTES", size - 1, raising=False)
    with pytest.raises(Exception, match=f"can't hold the {size} bytes of a book .*book_url=b"):
        files.exported_texts(spark, str(tmp_path / "out")).collect()
    written = b"".join(p.read_bytes() for p in (tmp_path / "out" / "book_url=b").glob("*.txt"))
    assert written.decode() == want["b"]


def test_all_references_of_html(spark):
    """Every name with and without its end, numbers of all kinds, and texts that only look like references."""
    import html

    names = sorted(html.entities.html5)
    texts = [f"a&{n}b" for n in names] + [f"&{n.rstrip(';')} {n}&{n}" for n in names]
    numbers = [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**9, 10**30]
    texts += [form.format(n) for n in numbers for form in ("&#{};", "x&#{}y", "&#x{:x};", "&#X{:X} ", "&#000000000{};")]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&notit;", "&notin;", "&ampamp;", "&nosuchname;", "&" + "a" * 40 + ";", "&amp;lt;", "\U0001f600&eacute;é", "&#12a;", "&a\nb;"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    bad = [(r["t"], r["u"]) for r in rows.select("t", T.unescaped(F.col("t")).alias("u")).collect() if r["u"] != (html.unescape(r["t"]) if r["t"] is not None else None)]
    assert not bad, bad[:5]


def test_search_by_postings(spark, tmp_path):
    """The rows of a plain search for keywords of all lengths and rarities; a rare one leaves few chapters to read."""
    from folio.operators import postings

    texts = ["The cat sat", "a CATALOGUE of cats", "", "ca", None, "naïve Straße 😀 猫猫猫", "catcatcat", "sat on the mat", "x" * 5000 + "needle"]
    rows = [("b%d" % (k % 3), k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "book_url string, chapter_index int, content string")
    path = str(tmp_path / "postings")
    postings.append(df.where("chapter_index < 5"), path)
    postings.append(df.where("chapter_index >= 5"), path)
    for keyword in ("cat", "Cats", "ca", "a", "needle", "nothing here", "😀 猫", "猫猫猫", "sat on", "e 😀"):
        want = sorted(map(tuple, chapters.search_books(df, keyword, most=2).collect()))
        assert sorted(map(tuple, postings.search_books(df, path, keyword, most=2).collect())) == want, keyword
    assert [tuple(r) for r in postings.candidates(path, "needle", df).collect()] == [("b2", 8)]
    assert postings.candidates(path, "nothing here", df).count() == 0 and postings.candidates(path, "ca", df) is None


def test_statistics_of_all_shapes(spark):
    shapes = {
        '{"today": 5, "week": -3, "total": 1.5, "books": ["A", "", {"name": "B", "bookUrl": "u", "seconds": 2, "chars": "7", "count": 1}]}': ([(5.0, 0.0), (0.0, 0.0), (1.5, 0.0)], [("A", None, None, None, None), ("B", "u", 2.0, 7.0, 1.0)]),
        '{"today": {"seconds": 9, "minutes": 3, "count": 2}, "week": {"minutes": 1.25}, "total": {"seconds": "9"}, "topBooks": [{"bookName": "C", "name": 4}, {"x": 1}, 7, null]}': ([(9.0, 2.0), (75.0, 0.0), (0.0, 0.0)], [("C", None, None, None, None)]),
        '{"today": "x", "week": null, "total": [1]}': ([(0.0, 0.0)] * 3, []),
        "{}": ([(0.0, 0.0)] * 3, []),
        "[1]": (None, None),
        "{bad": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in shapes] + [(None,)], "raw string")
    for r in stats.imported(df, F.col("raw"), "raw").collect():
        cells, top = shapes.get(r["raw"], (None, None))
        assert (None if r["today"] is None else [tuple(r[c]) for c in ("today", "week", "total")]) == cells, r["raw"]
        assert (None if r["top"] is None else [tuple(b) for b in r["top"]]) == top, r["raw"]
