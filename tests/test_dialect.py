import pytest

from tempora.dialect.lexer import DialectError
from tempora.dialect.parser import Insert, Select, parse


def test_both_vocabularies_say_the_same():
    assert parse("SELECT a, COUNT(*) FROM t WHERE a = 1 GROUP BY a ORDER BY a DESC LIMIT 3;") == parse("2E5TAR a, 3ADD(*) MEN t LAMA a = 1 MAGMO3A B a RATEB B a NAZL 7ADD 3;")


def test_numbers_strings_and_links():
    s = parse("SELECT * FROM parcel WHERE weight >= 2.25 OR fragile = FALSE AND shelf = -7;")
    assert [(c.left.column, c.right, c.link) for c in s.where] == [("weight", 2.25, "AND"), ("fragile", False, "OR"), ("shelf", -7, "AND")]
    assert parse("INSERT INTO parcel VALUES ('crate', -3, 0.75);") == Insert("parcel", (), (("crate", -3, 0.75),))


def test_other_names_of_tables():
    s = parse("SELECT p.id, q.id FROM parcel p INNER JOIN parcel AS q ON p.id = q.next WHERE p.id > 1;")
    assert (s.alias, s.joins[0].alias, s.joins[0].table) == ("p", "q", "parcel")
    assert parse("SELECT * FROM parcel AS OF 17;").alias == "" and parse("SELECT * FROM parcel LAMA id = 1;").alias == ""


def test_words_are_keywords_only_in_place():
    assert parse("SELECT b, k FROM t ORDER BY b;").items[0].column == "b"
    assert isinstance(parse("SELECT DISTINCT a FROM t AS OF 17;"), Select)


@pytest.mark.parametrize("text", ["SELECT FROM t;", "SELECT * FROM t", "FROB x;", "SELECT * FROM t WHERE a ~ 1;", "SELECT * FROM t; x"])
def test_bad_syntax(text):
    with pytest.raises(DialectError):
        parse(text)
