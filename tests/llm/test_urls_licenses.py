import pathlib
import re

import pytest

from postlens.llm import licenses, urls

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.com/en/a?x#y", "https://m.example.com/en/", "https://www.example.com/enx",
    "http://com/x", "http://a.com", "http://a.com?x=://b.net/es/", "http://a.net/es/1", "http://b.net/fr/", "http://bnet/fr/",
    "http://c.org/p", "https://www.c.org/p/", "http://c.org:80/p?utm=1", "http://c.org/q", "x://d.net/de/1", "http://e.org/a\nb",
]


def brute(url):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1], match[2]) if match else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_rules_and_listed_addresses(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS path", "3 AS rule")
    listed = spark.createDataFrame([("http://C.org/p/",), (None,), ("junk",)], "url string")
    got = {r["page_id"]: r for r in urls.judge(pages, listed).collect()}
    for i, url in enumerate(URLS):
        host, path, best = brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1]), url
        hit = host.split(":")[0].removeprefix("www.") == "c.org" and path.rstrip("/") == "/p"
        assert got[i]["verdict"] == (best[0] if best else "block" if hit else "allow"), url
        assert got[i]["listed"] == (best is None and hit)


def test_bloom_filter_lets_every_listed_address_through_and_few_others(spark):
    listed = spark.range(5000).selectExpr("concat('h.example/', id) AS address")
    others = spark.range(5000, 25000).selectExpr("concat('h.example/', id) AS address")
    n_words = urls.words_for(5000)
    bloom = urls.bloom_filter(listed, n_words)
    assert urls.possible(listed, bloom, n_words).count() == 5000
    assert urls.possible(others, bloom, n_words).count() < 0.05 * 20000


@pytest.mark.parametrize("name", ["pages", "listed"])
def test_empty_tables(spark, name):
    pages = spark.createDataFrame([(1, "http://c.org/p")], "page_id bigint, url string")
    listed = pages.select("url")
    if name == "pages":
        assert urls.judge(pages.limit(0), listed).count() == 0
    else:
        assert [r["verdict"] for r in urls.judge(pages, listed.limit(0)).collect()] == ["allow"]


def test_licences_survive_rewording_of_form(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = [
        mit, mit.upper(), "Copyright (c) 2020 Some One\n\n" + mit.replace("License", "Licence") + "\n", mit.replace(",", " ; ").replace("\n", "  "),
        mit + " not", None, "", "Prose.\nreleased under the MIT licence!\nMore.\nLicensed under CC BY-NC 4.0", "© 2020 x\nprose",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS digest", "2 AS name")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(docs).collect()}
    assert [got[i][0] for i in range(9)] == ["MIT"] * 4 + [None] * 5
    assert got[7][1] == "CC-BY-NC-4.0 notice; MIT notice" and got[6][1] is None
    assert licenses.scan(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "Released under the MIT License."), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert sorted(str(r["notices"]) for r in licenses.scan(odd).collect()) == ["MIT notice", "None", "None"]


def test_licences_with_and_without_titles_and_named_copyright_lines(spark):
    known = dict(licenses.KNOWN)
    body = {name: known[name].removeprefix(f"{name} License\n\n") for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "Zlib")}
    two, third = body["BSD-2-Clause"], "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    three = two.replace("THIS SOFTWARE IS", third + " products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS", 1)
    holder = "Copyright Foo Inc. 2020\n\n"
    cases = [(name, text) for name, text in body.items()]
    cases += [(name, holder + text) for name, text in body.items()]
    cases += [("MIT", "The MIT License (MIT)\n\n" + holder + body["MIT"]), ("Zlib", "zlib License\n\n" + body["Zlib"])]
    cases += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2019, Foo\nAll rights reserved.\n\n" + two)]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + three.replace("1. ", "").replace("2. ", "")), (None, holder + body["MIT"] + " not")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_long_texts_are_known_where_the_machine_has_them(spark):
    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(want, (folder / name).read_text()) for name, want in names.items() if (folder / name).exists()]
    if not found:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(found)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()} == {i: want for i, (want, _) in enumerate(found)}
