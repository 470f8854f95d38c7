"""Licence notices as they are published: wrapped, in comments, several in one paragraph."""

from terralog.llm.license_scan import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version %s of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""


def marked(text, mark):
    return "\n".join(f"{mark} {line}" for line in text.split("\n"))


def found(spark, cases):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses(docs).collect()} == {k: f for k, (_, f) in enumerate(cases)}


def test_wrapped_notices(spark):
    notices = [(MIT, "mit"), (BSD, "bsd"), (GPL % 3, "gpl-3.0"), (GPL % 2, "gpl-2.0"), ((GPL % 3).replace("GNU General", "GNU Lesser General"), "lgpl"), (MPL, "mpl-2.0"), (APACHE, "apache-2.0")]
    found(spark, [*notices, *[(marked(t, " *"), f) for t, f in notices], *[(marked(t, "dnl"), f) for t, f in notices[:2]], ("a b c\n#\n" + marked(MIT, "#") + "\n#\nmore", "mit")])


def test_several_families_in_one_paragraph(spark):
    two = "Released under the MIT license before 2020, released under the Apache 2.0 license since then."
    prose = "seats are reserved for members and the license plate of the car was missing " * 20
    found(spark, [(two, "apache-2.0,mit"), (prose + two + " " + prose, "apache-2.0,mit"), (prose, "")])
