from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import queries
from shelfmark.llm.license_texts import DIGESTS, LICENSES
from shelfmark.llm.licenses import canonical, known_licenses, scanned
from shelfmark.llm.q_licenses import OP1_SQL
from tests.oracle import assert_matches

MIT = LICENSES["MIT"]
VARIANTS = {
    "MIT": [MIT, MIT.upper(), MIT.replace(", ", ",\n   "), MIT.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) 2019-2024 Ana Díaz\n© 2020 Someone Else\nAll rights reserved."), "// " + MIT.replace("\n", "\n// "), MIT.replace('"', "“").replace("MIT License", "MIT Licence"), MIT.replace("\n", "\r\n")],
    "Zlib": [LICENSES["Zlib"].replace("acknowledgment", "acknowledgement")],
    "BSD-3-Clause": [LICENSES["BSD-3-Clause"].replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT OWNER OR")],
    "Apache-2.0 notice": [LICENSES["Apache-2.0 notice"].replace("http://", "https://")],
    None: [None, "", " \n", "...", MIT + " and more", MIT[:-40], "Copyright (c) 2020 X", "The MIT License", "x" * 100_000],
}


def test_variants_are_found_and_others_are_not(spark):
    rows = [(i, want, t, "clash") for i, (want, t) in enumerate((k, t) for k, ts in VARIANTS.items() for t in ts)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, want string, text string, license_id string")
    out = scanned(df, known_licenses(spark)).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        assert r.license_id == r.want, (r.want, r.text)
    assert scanned(df.limit(0), known_licenses(spark)).count() == 0
    assert [r.license_id for r in scanned(df.limit(1), known_licenses(spark, {})).collect()] == [None]


def test_every_known_text_has_a_digest_of_its_own(spark):
    assert known_licenses(spark).count() == len(LICENSES)


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}


def test_full_texts_are_known_by_their_digests(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    rows = []
    for name, file in FILES.items():
        text = (folder / file).read_text()
        rows += [(name, text), (name, "Copyright (C) 2021 Some One\n" + text.upper().replace("\n", " \n\t")), (name, text.replace("license", "licence").replace(", ", " , ")), (None, text + " more")]
    out = scanned(spark.createDataFrame(rows, "want string, text string"), known_licenses(spark, digests=DIGESTS)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.license_id == r.want


@pytest.mark.parametrize("a,b", [("fulfilment of an authorised programme", "FULFILLMENT of an authorized program"), ("Non-Infringement", "noninfringement"), ("a & b", "A  and B"), ("Licence\n\nCopyright 2020 Foo", "license"), ("naïve—text", "NAÏVE TEXT")])
def test_normal_forms(spark, a, b):
    assert len({r.c for r in spark.createDataFrame([(a,), (b,)], "t string").select(canonical(F.col("t")).alias("c")).collect()}) == 1


def test_sql_says_the_same(spark):
    assert assert_matches(queries.QUERIES["op1_license_digests"](spark, "/root/testdata/sf0.001"), OP1_SQL, "/root/testdata/sf0.001")
