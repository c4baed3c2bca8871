"""Licences in their usual, hard-wrapped form."""

from askbase.llm import license_scan

MIT = '''MIT License

Copyright (c) 2020 Some Body. All rights reserved.

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
LIABILITY.
'''
BSD2 = '''Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD3 = BSD2 + '''
3. Neither the name of Some Body, Inc. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
GPL3 = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
'''
GPL2 = '''This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
'''


def test_wrapped_licences(spark):
    full = {"MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE,
            "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2}
    forms = {"plain": lambda t: t, "hash": lambda t: "".join(f"# {x}\n" for x in t.split("\n")),
             "star": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint main() {",
             "semicolon": lambda t: "".join(f";; {x}\n" for x in t.split("\n")),
             "crlf": lambda t: t.replace("\n", "\r\n"), "quotes": lambda t: t.replace('"', "”"),
             "bracket": lambda t: t.replace("1. ", "(1) ").replace("2. ", "(2) ").replace("3. ", "(3) "),
             "prose": lambda t: "words before\n\n" + t + "\nwords after"}
    rows = [(f"{name} {form}", change(text), name) for name, text in full.items() for form, change in forms.items()]
    rows.append(("gpl text", "  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Everyone\n\n" + GPL3,
                 "GPL-3.0-only"))
    rows.append(("line", "unfinished line\nLicensed under the MIT license\nunfinished line", "MIT"))
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    got = {r.doc_id: r.licences for r in license_scan.scan_licences(frame).collect()}
    assert got == {k: [name] for k, _, name in rows}
