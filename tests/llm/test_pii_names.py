"""Names whole, numbers with their country codes, no leaks and no ordinary words changed; over a table: one to one."""

import re

import pytest
from pyspark.sql import functions as F

from inkspan.llm import pii


@pytest.fixture(scope="module")
def replaced(spark):
    def run(*texts):
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        return [r.text for r in pii.replace_pii(d).orderBy("doc_id").collect()]

    return run


#: Texts with words that must go, and how what is left has to look.
PROBES = [
    ("Mrs. Anna Mary Brown-Lee came. Anna Brown-Lee left.", ["Anna", "Mary", "Brown", "Lee"], r"Mrs\. \w+ \w+ \w+-\w+ came\. \w+ \w+-\w+ left\."),
    ("Dr. Alice Jones spoke", ["Alice", "Jones"], r"Dr\. \w+ \w+ spoke"),
    ("Mr O'Neil and Mr. de Vries", ["Neil", "Vries"], r"Mr [A-Z]'[A-Z]\w+ and Mr\. de \w+"),
    ("hello, my name is Robert Miller.", ["Robert", "Miller"], r"hello, my name is \w+ \w+\."),
    ("write to user@例え.jp now", ["user", "例え"], r"write to \w{4}@\w{2}\.example\.jp now"),
    ("Mr. Will Grant. The Grant was given; a Grant, too. Grant left.", ["Will", "Mr. Grant"], r"Mr\. \w+ (\w+)\. The Grant was given; a Grant, too\. \1 left\."),
    ("call +1 415-555-2671 or +14155552671", ["415", "2671"], r"call \+1 \d{3}-\d{3}-\d{4} or \+1\d{10}"),
    ("call +44 20 7946 0958 or +380 44 555 1234", ["7946", "1234"], r"call \+44 \d\d \d{4} \d{4} or \+380 \d\d \d{3} \d{4}"),
    ("a\x01b Mr. John Smith c\x01d John Smith", ["John", "Smith"], r"a\x01b Mr\. (\w+ \w+) c\x01d \1"),
    ("Robert Miller wrote from robert.miller@corp.org", ["Robert", "Miller", "robert", "miller"], r"\w+ \w+ wrote from \w{6}\.\w{6}@\w{4}\.example\.org"),
    ("Robert Miller\n12 High Street\nTown", ["Robert", "Miller"], r"\w+ \w+\n12 High Street\nTown"),
    ("Professor J. R. van der Berg-Ö sat", ["J. R.", "Berg"], r"Professor [A-Z]\. [A-Z]\. van der \w+-\w+ sat"),
    ("меня зовут Иван Петров и всё", ["Иван", "Петров"], r"меня зовут [а-яА-Я]+ [а-яА-Я]+ и всё"),
    ("Mr. John Smith, then Dr. John Smith", ["John", "Smith"], r"Mr\. (\w+ \w+), then Dr\. \1"),
    ("Mr. Mr. Mr. said The Name is fine. my name is not given", [], r"Mr\. Mr\. Mr\. said The Name is fine\. my name is not given"),
]


def test_probes(replaced):
    for (text, gone, form), out in zip(PROBES, replaced(*[p[0] for p in PROBES])):
        assert re.fullmatch(form, out), (text, out)
        assert not any(g in out for g in gone), (text, out)


def test_numbers_of_one_phone_agree(replaced):
    one, two = replaced("+1 415-555-2671", "+14155552671")
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)


def test_one_to_one_over_a_table(spark):
    """No detected value is left, equal ones have equal surrogates, different ones of a kind different ones; nothing else changes."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pairs = d.join(pii.replace_pii(d).select("doc_id", F.col("text").alias("new"), "n_entities"), "doc_id").collect()
    # the kinds without names, in Python's words
    pattern = re.compile("|".join(f"({p})" for k, p in PYTHON.items()))
    seen, values = {}, set()
    for r in pairs:
        old, new = (r.text or ""), (r.new or "")
        a, b = [m for m in pattern.finditer(old)], [m for m in pattern.finditer(new)]
        assert len(a) == len(b) <= r.n_entities and [m.lastindex for m in a] == [m.lastindex for m in b]
        assert pattern.split(old)[:: pattern.groups + 1] == pattern.split(new)[:: pattern.groups + 1] if len(a) == r.n_entities else True
        for x, y in zip(a, b):
            assert seen.setdefault((x.lastindex, x.group()), y.group()) == y.group()
            values.add(x.group())
    assert len(seen) > 50 and len({(k[0], v) for k, v in seen.items()}) == len(seen)
    assert not values & set(seen.values())


PYTHON = {
    "email": r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?![\w-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "card": r"(?<![\d-])\d{16}(?![\d-])",
}
