"""Licences in notices, with holders' names, and where a text says that it has none."""

import pytest

from weftline.llm import licences

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CASES = [
    ("This software is not\nlicensed under the MIT License.", None),
    ("It was never formally\nlicensed under the MIT License.", None),
    ("This software is not licensed under the MIT License.", None),
    ("This software is\nlicensed under the MIT License.", "MIT"),
    ("All is well.\nLicensed under the MIT License.", "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD + "3. Neither the name of the copyright holder nor the names of its contributors\n   may be used to endorse or promote products derived from this software without\n   specific prior written permission.", "BSD-3-Clause"),
    (BSD + "3. Neither the name of Acme Widgets, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    (BSD + "3. The name of Jane Q. Doe may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    ("License: MIT", "MIT"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Released under the Artistic License 2.0", "Artistic-2.0"),
    ("Licensed under the EUPL v1.2.", "EUPL-1.2"),
    ("Nothing to see.", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("repeats", [1, 3])
def test_licences(spark, repeats):
    rows = [(k, text) for k, (text, _) in enumerate(CASES)] * repeats
    got = [(r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(k, want) for k, (_, want) in enumerate(CASES)] * repeats, key=str)
