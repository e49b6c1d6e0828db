"""Sources that read folders of files."""

from quillspark.sources import files


def test_html_items_are_joined_up_to_the_first_gap(spark, tmp_path):
    for name, text in {"a.html": "<p>one</p>", "b-ch0.html": "<p>x</p>", "b-ch1.html": "<p>y</p>", "b-ch3.html": "<p>lost</p>", "c-ch1.html": "<p>no start</p>", "d-ch0.html": ""}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "e-ch10.html").write_text("<p>10</p>")
    for i in range(10):
        (tmp_path / f"e-ch{i}.html").write_text(f"<p>{i}</p>")
    got = {r["id"]: r["text"] for r in files.html_items(spark, str(tmp_path)).collect()}
    assert got == {"a": "one", "b": "x y", "e": "0 1 2 3 4 5 6 7 8 9 10"}


def test_dictionary_files_become_entries(spark, tmp_path):
    (tmp_path / "data.noun").write_text('  1 licence line\n00000001 03 n 02 goose 0 wild_goose 1 001 @ 00000009 n 0000 | a large bird; "the geese flew"; also its meat\n00000002 03 n 01 book 0 000 | pages\n')
    (tmp_path / "data.adj").write_text("00000003 00 s 01 quick(p) 0 000 | fast\n")
    (tmp_path / "index.noun").write_text("  1 licence line\ngoose n 1 1 @ 1 0 00000001  \nwild_goose n 1 0 1 0 00000001\nbook n 2 2 @ ~ 2 1 00000002 00000009\n")
    (tmp_path / "index.adj").write_text("quick a 1 0 1 0 00000003\n")
    entries = files.dictionary(files.senses(spark, str(tmp_path / "index.*")), files.synsets(spark, str(tmp_path / "data.*")))
    assert [tuple(r) for r in entries.collect()] == [
        ("book", "n", 1, "pages", None, []),
        ("goose", "n", 1, "a large bird; also its meat", "the geese flew", ["wild goose"]),
        ("quick", "a", 1, "fast", None, []),
        ("wild goose", "n", 1, "a large bird; also its meat", "the geese flew", ["goose"]),
    ]
