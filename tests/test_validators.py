from pyspark.sql import functions as F

from veilspan.functions.validators import VALIDATORS

CASES = [
    ("luhn", "4111 1111 1111 1111", True),
    ("luhn", "4111111111111112", False),
    ("luhn", "7", False),
    ("nhs_mod11", "943 476 5919", True),
    ("npi_80840", "1234567893", True),
    ("dea", "AB1234563", True),
    ("iban_mod97", "GB82 WEST 1234 5698 7654 32", True),
    ("iban_mod97", "GB82 WEST 1234 5698 7654 33", False),
    ("pesel", "44051401359", True),
    ("bsn_11proef", "111222333", True),
    ("belgium_rrn", "85.07.30-033.28", True),
    ("spain_dni", "DNI 12345678Z", True),
    ("spain_dni", "NIE: X1234567L", True),
    ("brazil_cpf", "529.982.247-25", True),
    ("brazil_cpf", "111.111.111-11", False),
    ("brazil_cnpj", "12.ABC.345/01DE-35", True),
    ("estonia_isikukood", "37605030299", True),
    ("romania_cnp", "1800101221144", True),
    ("china_rid", "11010519491231002X", True),
    ("turkey_tckn", "10000000146", True),
    ("israel_id", "000000018", True),
    ("us_ssn", "666-45-6789", False),
    ("e164", "+800 1234 5678", False),
    ("phone_us", "+1 (555) 555-0123", True),
    ("vin_na", "VIN: 1M8GDM9AXKP042788", True),
    ("iso6346", "CSQU3054383", True),
    ("usps_s10", "EA123456785US", True),
    ("geo_coord", "geo:137.78,-122.4", False),
    ("orcid", "0000-0002-1825-0097", True),
    ("isin", "US0378331005", True),
]


def test_known_vectors(spark):
    df = spark.createDataFrame(CASES, "kind string, v string, want boolean")
    got = None
    for kind in dict.fromkeys(k for k, _, _ in CASES):
        value = VALIDATORS[kind](F.col("v"))
        got = F.when(F.col("kind") == kind, value) if got is None else got.when(F.col("kind") == kind, value)
    wrong = [tuple(r) for r in df.withColumn("got", got).collect() if r["got"] != r["want"]]
    assert wrong == []
