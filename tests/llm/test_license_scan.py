"""Licence scan: the SQL version, whole licence headers, odd rows, no Python in the plan."""

import duckdb

from parlance.llm import license_scan as L

APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//     http://www.apache.org/licenses/LICENSE-2.0
// Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS.
// See the License for the specific language governing permissions and limitations under the License.
"""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the
 * GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or
 * (at your option) any later version.
 * This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
 * See the GNU General Public License for more details.
 * You should have received a copy of the GNU General Public License along with this program."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted.
Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice.
{}This software is provided by the authors "as is" and any express or implied warranties are disclaimed."""
CASES = {
    1: (APACHE, "Apache-2.0"),
    2: ("Prose here. Released under the MIT License.", "MIT"),
    3: ("x\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    4: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    5: (BSD.format(""), "BSD-2-Clause"),
    6: (BSD.format("Neither the name of X may be used to endorse or promote products. "), "BSD-3-Clause"),
    7: ("MIT License. Copyright (c) 2020 A. All rights reserved. Permission is hereby granted, free of charge, to any "
        "person obtaining a copy of this software. The above copyright notice and this permission notice shall be "
        "included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.", "MIT Proprietary"),
    8: ("Licensed under some thing.", "Unknown-license"),
    9: ("no such words", ""),
    10: (None, ""),
    11: ("", ""),
    12: ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0 MIT"),
    13: (GPL, "GPL-2.0-or-later"),
    14: ("word, " * 40000 + "end. Released under the MIT License", "MIT"),
}


def test_cases(spark, docs_of):
    rows = [(i, t) for i, (t, _) in CASES.items()] + [(2, CASES[2][0]), (None, CASES[2][0])]
    out = L.scan_licenses(docs_of(rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: " ".join(r.licenses) for r in out}
    assert {i: got[i] for i in CASES} == {i: w for i, (_, w) in CASES.items()}
    assert next(r for r in out if r.doc_id == 7).sentence_ids[0] == "MitTitle"
    assert L.scan_licenses(docs_of([])).count() == 0


def test_query_matches_sql(spark, sf="/root/testdata/sf0.01"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.execute(L.oracle_sql()).fetchall())
    df = L.op4_license_scan(spark, sf)
    assert sorted(map(tuple, df.collect())) == want and sum(r[3] for r in want) > 20
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
