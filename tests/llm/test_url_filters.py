from quoteflow.llm.url_filters import RULES, judged, rule_table


def pages(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "page_id long, url string, html string, host long, rule long")


def plain(rows):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str)


def test_rules_by_host_and_path(spark):
    rows = [
        (1, "http://A.Example.COM/en/x?q", None),
        (2, "https://www.example.com/en/", ""),
        (3, "https://a.b.net/fr/1#t", ""),
        (4, "https://anet/fr/1", ""),
        (5, "https://com?x/en/", ""),
        (6, "https://com/", ""),
        (7, None, "<p>"),
        (8, "no scheme/en/", None),
        (9, "x://NET/es/../y", None),
        (9, "x://NET/es/../y", None),
        (None, "http://q.com/a://b", None),
    ]
    assert plain(judged(pages(spark, rows), rule_table(spark, RULES)).collect()) == sorted(
        [
            (1, "a.example.com", "/en/x", "example.com/en/", "block"),
            (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (3, "a.b.net", "/fr/1", "net/fr/", "block"),
            (4, "anet", "/fr/1", None, "allow"),
            (5, "com", "", None, "allow"),
            (6, "com", "/", "com/", "allow"),
            (7, "", "", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "net", "/es/../y", "net/es/", "block"),
            (9, "net", "/es/../y", "net/es/", "block"),
            (None, "q.com", "/a://b", "com/", "allow"),
        ],
        key=str,
    )


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    rows = [
        (1, "https://a.org/1", '<link rel="canonical" href="https://b.org/2?x=1&amp;y=2">'),
        (2, "http://b.org/2?x=1&y=2#top", "<META HTTP-EQUIV='Refresh' CONTENT='0; URL=https://bad.net/fr/3'>"),
        (3, "https://bad.net/fr/3", ""),
        (4, "https://c.com/4", "<link href='//bad.net/fr/3' rel=canonical>"),
        (5, "https://d.org/dir/5", "<link rel=canonical href=other>"),
        (6, "https://d.org/dir/other", "<link rel='canonical' href='/root'>"),
        (7, "https://e.org/7", "<!-- <link rel=canonical href=https://bad.net/fr/3> -->"),
        (8, "https://f.org/8", "<link rel=stylesheet href=https://bad.net/fr/3>"),
    ]
    moved = spark.createDataFrame([("https://d.org/root", "https://x.net/es/"), ("https://g.org", None)], "from_url string, to_url string")
    got = {r.page_id: (r.verdict, r.inherited) for r in judged(pages(spark, rows), rule_table(spark, RULES), moved).collect()}
    assert got == {
        1: ("block", True),
        2: ("block", True),
        3: ("block", False),
        4: ("allow", False),
        5: ("block", True),
        6: ("block", True),
        7: ("allow", False),
        8: ("allow", False),
    }


def test_no_rows(spark):
    assert judged(pages(spark, []), rule_table(spark, RULES)).collect() == []
    assert judged(pages(spark, [(1, "http://a.com/", "")]), rule_table(spark, [])).first().verdict == "allow"
