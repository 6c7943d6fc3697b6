import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Released under the MIT License.\nAll rights reserved."),
    (2, None),
    (3, ""),
    (4, " \n\t \n"),
    (5, "one two three four five six seven eight " * 9),
    (5, "one two three four five six seven eight " * 9),
    (6, "Ärger über Öl.\n" * 40),
    (7, "word " * 30000),
    (None, "a row without an id, under the mit license and cc-by-nc."),
    (8, "A|B|C|D\nHome | About | Contact | Login\n\x0b\x0cend \x85 of line x  y\n \n z"),
    (9, "<|endoftext|> it's we'll \U0001f600́ ½ ² x_y\r\n\r\n\ttab"),
    (10, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names operators like to use."""
    rows = [(i, t, "en", "src", 1, "x", 2.0, "y") for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, words string, score double, piece string"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
