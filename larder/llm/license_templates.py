"""License templates in markup (fixed values: the wording of public licences).

``[[ ... ]]`` is an optional region (may hold others), ``{{a-b}}`` a replaceable
region of a to b words; all other wording is mandatory.  Case, punctuation and
layout do not count: texts are compared as words.
"""

TEMPLATES: list[tuple[str, str]] = [
    ("mit", """
     [[The]] [[MIT License]] [[(MIT)]] [[Copyright [[(c)]] {{0-24}}]]
     Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including
     without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
     copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
     following conditions:
     The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included
     in all copies or substantial portions of the Software.
     THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
     LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
     EVENT SHALL {{2-24}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
     TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
     THE SOFTWARE."""),
    ("isc", """
     [[ISC License]] [[Copyright [[(c)]] {{0-24}}]]
     Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
     THE SOFTWARE IS PROVIDED "AS IS" AND {{1-24}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
     INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{1-24}} BE LIABLE FOR
     ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
     DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
     CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """
     [[BSD 2-Clause License]] [[Copyright [[(c)]] {{0-24}}]] [[All rights reserved.]]
     Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met:
     [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and
     the following disclaimer.
     [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution.
     THIS SOFTWARE IS PROVIDED BY {{1-24}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
     LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("bsd-3-clause", """
     [[BSD 3-Clause License]] [[Copyright [[(c)]] {{0-24}}]] [[All rights reserved.]]
     Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met:
     [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and
     the following disclaimer.
     [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
     the following disclaimer in the documentation and/or other materials provided with the distribution.
     [[3.]] Neither the name of {{1-24}} nor the names of its contributors may be used to endorse or promote
     products derived from this software without specific prior written permission.
     THIS SOFTWARE IS PROVIDED BY {{1-24}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
     LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("zlib", """
     [[zlib License]] [[Copyright [[(c)]] {{0-24}}]]
     This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
     held liable for any damages arising from the use of this software.
     Permission is granted to anyone to use this software for any purpose, including commercial applications, and
     to alter it and redistribute it freely, subject to the following restrictions"""),
    ("apache-2.0", """
     Licensed under the Apache License, Version 2.0 [[(the "License");]] [[you may not use this file except in
     compliance with the License.]] [[You may obtain a copy of the License at {{1-8}}]] [[Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
     BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.]]"""),
    ("gpl-2.0", """
     licensed under [[the terms of]] the GNU General Public License [[as published by the Free Software
     Foundation]] [[either]] version 2 [[of the License]] [[or (at your option) any later version]]"""),
    ("gpl-3.0", """
     licensed under [[the terms of]] the GNU General Public License [[as published by the Free Software
     Foundation]] [[either]] version 3 [[of the License]] [[or (at your option) any later version]]"""),
    ("gpl-2.0", """
     free software [[you can]] redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation [[either]] version 2 [[of the License]] [[or (at your
     option) any later version]]"""),
    ("gpl-3.0", """
     free software [[you can]] redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation [[either]] version 3 [[of the License]] [[or (at your
     option) any later version]]"""),
    ("mit", "[[Released]] [[Licensed]] [[Distributed]] under [[the terms of]] the MIT License"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[Creative Commons {{0-4}}]] CC BY 4.0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[Creative Commons {{0-4}}]] CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[Creative Commons {{0-4}}]] CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] Creative Commons Attribution ShareAlike 4.0 International License"),
]
