from symgrain.llm import url_filter as u
from symgrain.llm.oracles import ORACLES


def test_rules_terms_and_edges(spark):
    rows = [
        ("http://a.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://example.com/en/8#t", "example.com", "/en/8", "com/en/", "block"),
        ("http://myexample.com/en/7", "myexample.com", "/en/7", "com/en/", "block"),
        ("http://example.net/de/85", "example.net", "/de/85", "example.net/de/8", "block"),
        ("http://b.org?x=/es/", "b.org", "", None, "allow"),
        ("no scheme porn", "", "", None, "block"),
        ("http://x.io/free-XXX-pics", "x.io", "/free-XXX-pics", None, "block"),
        ("http://sussex.ac.uk/adult", "sussex.ac.uk", "/adult", None, "allow"),
        ("http://x.io/adult/adult", "x.io", "/adult/adult", None, "allow"),
        ("http://x.io/adult_dating", "x.io", "/adult_dating", None, "block"),
        ("http://porn.com/en/7", "porn.com", "/en/7", "com/en/", "block"),
        ("http://example.com/en/7porn?xxx", "example.com", "/en/7porn", "example.com/en/7", "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    got = {r["page_id"]: tuple(r)[1:5] for r in u.judge_urls(pages, u.RULES).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    assert u.judge_urls(pages.limit(0), u.RULES).count() == 0


def test_equal_lengths_take_the_longer_host():
    judge = u.UrlJudge((u.Rule("block", "com", "/aa.b"), u.Rule("allow", "b.com", "/aa.")), {}, 1.0)
    assert judge.rule("b.com", "/aa.b").verdict == "allow"


def test_registered_rules_say_what_the_contract_says():
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert [(r.verdict, r.text) for r in u.RULES] == rules
    assert all(f"'{verdict}')" in ORACLES["op9_url_filter"].split(f"('{text}', ")[1].split(", (")[0] for verdict, text in rules)
    judge = u.UrlJudge(u.RULES, u.VOCABULARY, u.THRESHOLD)
    urls = ["http://a.net/de/1", "http://example.net/de/7", "http://a.net/de/porn", "http://example.net/de/8", "http://a.net/en/porn", "http://a.org/es/"]
    assert [judge.judge(x)[3] for x in urls] == ["allow", "allow", "allow", "block", "block", "block"]
