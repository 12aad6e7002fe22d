"""The standard texts of licences, wrapped, in a comment and on one line."""

import re

from nearfield.llm import licenses

# licences' published texts.
MIT = """MIT License

Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, A. Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
ISC = """Copyright (c) 2004-2010 by A Name <a@b.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
"""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
LGPL3 = """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>

  This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE = """Copyright 2020 A Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
"""
TEXTS = {"MIT": MIT, "BSD": BSD, "ISC": ISC, "GPL-3.0": GPL3, "GPL-2.0": GPL2, "LGPL-2.1": LGPL, "LGPL-3.0": LGPL3, "MPL-2.0": MPL, "Apache-2.0": APACHE}


def test_standard_texts(spark):
    forms = {
        "wrapped": lambda t: t,
        "crlf": lambda t: "code();\n\n" + t.replace("\n", "\r\n"),
        "star": lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.split("\n")) + " */\nint x;",
        "hash": lambda t: "".join(f"# {x}\n" for x in t.split("\n")),
        "one": lambda t: re.sub(r"\s+", " ", t),
    }
    rows = [(f"{name} {form}", f(t)) for name, t in TEXTS.items() for form, f in forms.items()]
    rows += [("none a", MIT.replace("free of charge", "for a fee")), ("none b", "the Free Software Foundation,\neither version 3 of the License"), ("none c", BSD[40:].replace("permitted", "forbidden").split("\n\n")[1])]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for key, found in got.items():
        name = key.split()[0]
        assert [x for x in found if x != "Proprietary"] == ([] if name == "none" else [name]), (key, found)
