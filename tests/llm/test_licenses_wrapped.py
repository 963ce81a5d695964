import textwrap

from vistrack.llm import licenses

NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def test_wrapped_notices(spark):
    rows, want = [], []
    for family, text in NOTICES.items():
        for width, prefix in ((72, ""), (60, "# ")):
            notice = "\n".join(prefix + x for x in textwrap.wrap(text, width))
            for whole in (notice, f"Some title\n\n{notice}\n\nand more text", "\n".join(["plain words of a story"] * 11 + [notice])):
                rows.append((len(rows), whole))
                want.append(family)
    rows.append((len(rows), "she asked for permission\nto leave the house\nand use her copy"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.families for r in licenses.scan(docs, licenses.train(spark, docs)).collect()}
    assert got == dict(enumerate([*want, ""]))
