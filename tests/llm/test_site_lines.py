from larder.llm import site_lines

SCHEMA = "page_id long, url string, html string"


def found(df):
    return {r["page_id"]: (r["host"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()}


def test_lines_common_on_a_site_go_and_stay_elsewhere(spark):
    rows = [(i, f"https://U@Shop.example.com:80/{i}?x", f"<nav>Home</nav><p>Own {i}</p><script>Home</script><b>Buy</b> now") for i in range(5)]
    rows += [(10 + i, f"http://blog.example.com/{i}", f"<p>Home</p><p>text {i}</p>" if i == 0 else f"<p>text {i}</p>") for i in range(5)]
    out = found(site_lines.drop_site_lines(spark.createDataFrame(rows, SCHEMA)))
    assert out[3] == ("shop.example.com", 3, 2, "Own 3")
    assert out[10] == ("blog.example.com", 2, 0, "Home\ntext 0")


def test_rare_lines_and_single_pages_are_left_alone(spark):
    rows = [(1, "http://a.b/1", "x<br>y"), (2, "http://c.d/2", "x<br>z")] + [(10 + i, f"http://e.f/{i}", f"own {i}<br>{'now and then' if i < 3 else ''}") for i in range(10)]
    assert all(r[2] == 0 for r in found(site_lines.drop_site_lines(spark.createDataFrame(rows, SCHEMA))).values())


def test_menu_of_a_two_page_site_goes(spark):
    rows = [(1, "http://a.b/1", "menu<br>y"), (2, "http://a.b/2", "menu<br>z")]
    assert {i: r[3] for i, r in found(site_lines.drop_site_lines(spark.createDataFrame(rows, SCHEMA))).items()} == {1: "y", 2: "z"}


def test_nulls_repeats_long_and_clashing(spark):
    rows = [(1, None, "q", 1), (2, "not a url", "q", 1), (3, "", "q", 1), (None, "http://h/", None, 1), (4, "http://h/", "", 1), (5, "http://h/", "z " * 200_000, 1)]
    rows += [(6, "http://k/", "same", 1)] * 4
    out = site_lines.drop_site_lines(spark.createDataFrame(rows, SCHEMA + ", lines int")).collect()
    assert len(out) == len(rows)
    by = {r["page_id"]: r for r in out}
    assert [by[i]["n_dropped"] for i in (1, 2, 3, 6)] == [1, 1, 1, 1]
    assert by[None]["text"] == "" and by[4]["n_lines"] == 0 and len(by[5]["text"]) == 399_999
    assert site_lines.drop_site_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_table(spark):
    assert site_lines.drop_site_lines(spark.createDataFrame([], SCHEMA)).collect() == []
