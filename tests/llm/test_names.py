"""Forms of names and account numbers."""

import re

from barley.llm import pii

TEXTS = ["Mr. McDonald met Mr. Jean-Luc Picard.", "Mrs. O'Brien and Mrs. O’Neill-Smith", "Mr. JOHN SMITH, then Mr. John Smith.", "Frau MÜLLER sah Frau Müller",
         "Dr. Alice Walker; Prof. Walker", "Mr. Γιώργος Παπαδάκης", "Mr. Smith AND the rest", "Mr. Smith's dog", "Mr. SMITHson",
         "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "GB00WEST12345698765432"]


def iban_right(iban):
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def test_forms(spark):
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string"), "k").collect()
    out = [r.text for r in sorted(rows, key=lambda r: r.doc_id)]
    kinds = [[p.type for p in r.pii] for r in sorted(rows, key=lambda r: r.doc_id)]
    assert kinds[:8] == [["name"] * n for n in (2, 2, 2, 2, 2, 1, 1, 1)] and kinds[8] == [] and kinds[9:] == [["iban"] * 2, ["iban"], ["iban"]]
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ met Mr\. [A-Z][a-z]+ [A-Z][a-z]+\.", out[0]), out[0]
    assert re.fullmatch(r"Mrs\. [A-Z][a-z]+ and Mrs\. [A-Z][a-z]+", out[1]), out[1]
    upper, plain = re.fullmatch(r"Mr\. ([A-Z]+ [A-Z]+), then Mr\. ([A-Z][a-z]+ [A-Z][a-z]+)\.", out[2]).groups()
    assert upper == plain.upper() and plain != "John Smith"
    upper, plain = re.fullmatch(r"Frau ([A-Z]+) sah Frau ([A-Z][a-z]+)", out[3]).groups()
    assert upper == plain.upper()
    one, two = re.fullmatch(r"Dr\. [A-Z][a-z]+ ([A-Z][a-z]+); Prof\. ([A-Z][a-z]+)", out[4]).groups()
    assert one == two
    assert re.fullmatch(r"Mr\. [Α-Ω][α-ω]+ς [Α-Ω][α-ω]+", out[5]), out[5]
    surname = plain_surname = re.fullmatch(r"Mr\. ([A-Z][a-z]+) AND the rest", out[6]).group(1)
    assert out[2].endswith(f" {surname}.") and out[7] == f"Mr. {plain_surname}'s dog" and out[8] == TEXTS[8]
    spaced, plain = re.fullmatch(r"IBAN (DE[0-9 ]{25}) or (DE\d{20})", out[9]).groups()
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000" and iban_right(plain)
    assert [len(g) for g in spaced.split()] == [4, 4, 4, 4, 4, 2]
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", out[10]) and iban_right(out[10].replace(" ", ""))
    assert re.fullmatch(r"GB00[A-Z]{4}\d{14}", out[11]) and out[11] != TEXTS[11]
