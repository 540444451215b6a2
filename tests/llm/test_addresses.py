"""The same postal address in other words."""

from pyspark.sql import functions as F

from fernweave.llm import addresses as A

SCHEMA = "id long, a string, c string, p string, form string, street string"


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    return {tuple(r) for r in A.same_address(frame, "id", F.col("a"), F.col("c"), F.col("p")).collect()}


def test_wordings_of_one_place(spark):
    same = [
        ("13 Bobapabe Road, Gomor, Gullhaven, ZB3 9YA", "Gullhaven", "ZB3 9YA"),
        ("BOBAPABE ROAD, NO. 13, GULLHAVEN, ZB39YA", "Gullhaven", None),
        ("13 Bobapabe Rd., Gomor, ZB39YA, UK", "Gullhaven", "GB-ZB3 9YA"),
        ("Floor 2, 13 Bobpaabe Rd - Gullhaven", None, None),
        ("13 Bobapabe Road Gullhaven", None, None),
    ]
    rows = [(k, *r) for k, r in enumerate(same)]
    assert found(spark, rows) == {(a, b) for a in range(5) for b in range(a + 1, 5)}


def test_german_and_vietnamese_forms(spark):
    rows = [
        (1, "Kinosedistraße 35, 46303 Grünfurt", "Grünfurt", "46303"),
        (2, "KINOSEDISTRASSE 35 - 46303 GRÜNFURT - GERMANY", "Grünfurt", "46303"),
        (3, "Grunfurt, Kinosedi Str. 35", None, None),
        (4, "45/2 Đ. Fudubami, P.7, Q2, TP. Hồ Minh 528813", "Hồ Minh", None),
        (5, "Lầu 3, 45/2 Duong Fudubami, Phuong 7, Ho Minh", "Hồ Minh", "528813"),
        (6, "45 Đường Fudubami, Phường 7, Quận 2, Hồ Minh 528813", "Hồ Minh", "528813"),
    ]
    assert found(spark, rows) == {(1, 2), (1, 3), (2, 3), (4, 5)}


def test_other_places_stay_apart(spark):
    rows = [
        (1, "13 Pigebege Road, Marrowdale, OX 40241", "Marrowdale", "40241"),
        (2, "13A Pigebege Road, Marrowdale, OX 40241", "Marrowdale", "40241"),
        (3, "15 Pigebege Road, Marrowdale, OX 40241", "Marrowdale", "40241"),
        (4, "13 Pigebege Road, Kessel Bay, QA 40241", "Kessel Bay", "40241"),
        (5, "13 Pigebege Lane, Marrowdale, OX 40241", "Marrowdale", "40241"),
        (6, "13 Tosotaku Road, Marrowdale, OX 40241", "Marrowdale", "40241"),
    ]
    assert found(spark, rows) == set()


def test_nulls_placeholders_and_empty_tables(spark):
    rows = [(1, None, "Velburg", "1"), (2, "", "Velburg", None), (3, "-", "Velburg", None), (4, "-", "Velburg", None), (5, "Velburg", "Velburg", None), (6, "7", None, None)]
    assert found(spark, rows) == set()
    assert found(spark, []) == set()
    assert found(spark, [(1, "x" * 50_000 + " 5, Velburg", "Velburg", None), (2, "x" * 50_000 + " 5, Velburg", "Velburg", None)]) == {(1, 2)}


def test_two_misspellings_meet_by_the_right_name(spark):
    rows = [(k, "5 Kerebasi Road, Velburg", "Velburg", None) for k in range(3)] + [(7, "5 Kerbeasi Road, Velburg", "Velburg", None), (8, "5 Kerebsi Road, Velburg", "Velburg", None)]
    assert (7, 8) in found(spark, rows)


def test_near_names():
    assert A.near_names("kerebasi", "kerbeasi") and A.near_names("kerebasi", "kerebsi") and A.near_names("kerebasi", "kerebbasi") and A.near_names("kerebasi", "kerebaso")
    assert not A.near_names("kerebasi", "kerbeais") and not A.near_names("abcd", "abce")


def test_long_numbers_and_ranges(spark):
    rows = [
        (1, "10500 Main Street, Springfield, IL 62704", "Springfield", "62704"),
        (2, "10500 Main St., Springfield", None, None),
        (3, "62704 Springfield, Main Street 10500", "Springfield", None),
        (4, "10501 Main Street, Springfield, IL 62704", "Springfield", "62704"),
        (5, "12-14 Bobapabe Road, Velburg", "Velburg", None),
        (6, "12 Bobapabe Road, Velburg", "Velburg", None),
        (7, "14 Bobapabe Rd, Velburg", "Velburg", None),
        (8, "13 Bobapabe Rd, Velburg", "Velburg", None),
        (9, "14a Bobapabe Rd, Velburg", "Velburg", None),
    ]
    assert found(spark, rows) == {(1, 2), (1, 3), (2, 3), (5, 6), (5, 7)}


def test_house_numbers():
    assert A.house_numbers("12-16") == ["12", "14", "16"] and A.house_numbers("39/2") == ["39"] == A.house_numbers("39b") and A.house_numbers("7-900") == ["7", "900"]


def test_conflicting_house_numbers_share_a_hash(spark):
    rows = [(1, "39/2 Kerebasi Road, Velburg", "Velburg", None), (2, "39 Kerebasi Road, Velburg", "Velburg", None), (3, "39b Kerebasi Road, Velburg", "Velburg", None)]
    forms = A.address_forms(spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA), "id", F.col("a"), F.col("c"), F.col("p")).collect()
    assert {tuple(r.bases) for r in forms} == {("39",)} and found(spark, rows) == set()
