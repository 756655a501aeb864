from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm.boilerplate import drop_boilerplate, host_of, html_text, page_text_without_boilerplate

from .helpers import LONG


def plain(rows, ratio, least):
    spaces = " \t\n\x0b\x0c\r"
    lines = [[x for x in (line.strip(spaces) for line in (text or "").split("\n")) if x] for _, _, text in rows]
    pages, seen = Counter(), defaultdict(Counter)
    for (_, host, _), own in zip(rows, lines):
        if host is not None:
            pages[host] += 1
            seen[host].update(set(own))
    out = []
    for (i, host, _), own in zip(rows, lines):
        kept = [x for x in own if host is None or not (seen[host][x] >= least and seen[host][x] / pages[host] > ratio)]
        out.append((i, host, pages.get(host), len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ratio,least", [(0.2, 3), (0.5, 1), (0.0, 2)])
def test_lines_go_by_their_share_of_a_site(spark, ratio, least):
    rows = [(i, "hot" if i % 3 else f"h{i % 7}", "\n".join([" menu ", f"text {i}", "menu", f"part {i % 4}", "", "\tfoot\r", f"text {i}"])) for i in range(90)]
    rows += [(90, None, "menu\nfoot"), (91, None, None), (92, "hot", None), (93, "hot", ""), (None, "solo", "menu"), (5, "hot", rows[5][2]), (5, "hot", rows[5][2]), (94, "hot", LONG + "\nmenu")]
    frame = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("lines", F.lit(1)).withColumn("kept", F.lit("x"))
    got = drop_boilerplate(frame, "page_id", F.col("host"), F.col("text"), ratio, least).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, ratio, least)


def test_hosts_and_page_text(spark):
    urls = ["http://A.example.com/x", "https://u:p@b.example.com:8080?q", "ftp://c", "nothing", "", None, "http:///x"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()]
    assert got == ["a.example.com", "b.example.com", "c", None, None, None, None]
    page = '<html><script>var t="</p>";</script><p class="a">one <b>bold</b> word</p><!-- x\n<p>no</p> --><STYLE>p{}</STYLE><li>two<br/>three<pre>four</pre>'
    text = spark.createDataFrame([(page,)], "h string").select(html_text(F.col("h"))).first()[0]
    assert [x for x in text.split("\n") if x] == ["one bold word", "two", "three", "four"]


def test_pages_and_empty_table(spark):
    rows = [(i, f"http://s.example.com/{i}", f"<p>nav</p><p>own {i}</p>") for i in range(5)] + [(9, None, "<p>nav</p>"), (8, "http://t.example.com", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.n_dropped, r.text) for r in page_text_without_boilerplate(frame).collect()}
    assert got[0] == ("s.example.com", 1, "own 0") and got[9] == (None, 0, "nav") and got[8] == ("t.example.com", 0, "")
    assert page_text_without_boilerplate(frame.limit(0)).collect() == []
