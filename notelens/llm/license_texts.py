"""Templates of the license scan.

Fixed values: the base phrases with their labels, and public license notices and texts.
"""

from __future__ import annotations

from notelens.llm.licenses import Template

BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

_WORK = '<<beginOptional>>This <<var;name="work";original="work";match=".{1,4}">> is <<endOptional>>licensed under '
_GPL = (_WORK + "the <<beginOptional>>terms of the <<endOptional>>GNU General Public License<<beginOptional>> (GPL)<<endOptional>>"
        "<<beginOptional>> as published by the Free Software Foundation<<endOptional>><<beginOptional>>; either<<endOptional>>"
        " version VERSION<<beginOptional>>.0<<endOptional>><<beginOptional>> or (at your option) any later version<<endOptional>>")
_CC = (_WORK + "<<beginOptional>>a Creative Commons <<endOptional>><<beginOptional>>the <<endOptional>>CC KIND "
       '<<var;name="version";original="4.0";match="[1-4]">>.0<<beginOptional>> International<<endOptional>>'
       "<<beginOptional>> License<<endOptional>>")

NOTICES = (
    Template("gpl-2.0", _GPL.replace("VERSION", "2")),
    Template("gpl-3.0", _GPL.replace("VERSION", "3")),
    Template("apache-2.0", _WORK + "the Apache License<<beginOptional>> version<<endOptional>> 2.0"),
    Template("cc-by-notice", _CC.replace("KIND", "BY")),
    Template("cc-by-nc-notice", _CC.replace("KIND", "BY-NC")),
    Template("cc-by-sa-notice", _CC.replace("KIND", "BY-SA")),
    Template("mit-notice", '<<var;name="verb";original="Released";match="released|licensed|distributed|available">> under the '
                           "<<beginOptional>>terms of the <<endOptional>>MIT License"),
)

TEXTS = (
    Template("mit-text", '''
<<beginOptional>>The MIT License<<beginOptional>> (MIT)<<endOptional>><<endOptional>>
<<beginOptional>>Copyright (c) <<var;name="copyright";original="<year> <holders>";match=".{1,16}">><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice<<beginOptional>> (including the next paragraph)<<endOptional>> shall
be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,12}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'''),
    Template("isc-text", '''
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,8}">> DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'''),
)

TEMPLATES = (*BASE, *NOTICES, *TEXTS)
