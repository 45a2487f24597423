"""Precision and recall of the field on sentences that it was not trained on, by kind."""

import re
from collections import Counter

from tidemark.llm import pii

#: A held-out table in the form of the training table: other words, names, places and numbers.
HELD_OUT = """
My name is [name:Clara Jensen] and my date of birth is [birth:23/09/1991].|Dear [name:Mrs. Novak], your order has shipped|Patient: [name:Samuel Okoro], admitted on Monday|Regards, [name:Julia]|the customer [name:Paul Meyer] asked for help
I spoke with [name:Mr. Daniel Roth] about it|Name: [name:Elena Rossi]|Employee [name:Karim Aziz] was hired|Sincerely, [name:Laura Chen]|Full name: [name:David Lindqvist]
She lives at [address:48 Willow Street, Portland].|Ship to: [address:905 Lake Road, Chicago]|Address: [address:17 High Street]|they moved to [address:62 Park Lane] in spring|home address is [address:3 Church Road, Leeds]
Date of birth: [birth:30/01/1969]|born on [birth:9 June 1988] in Oslo|DOB: [birth:1992-07-15]|birth date is [birth:05-12-1977]|DOB [birth:22.04.1980]
Passport number: [document:H4482913]|passport number [document:M9917305] was stolen|driver license [document:F482-1190-3321] issued|Passport: [document:771203998]|ID card no [document:K552201B7]
SSN [ssn:322-91-4407] on file|his SSN is [ssn:541-08-3320].|ssn: [ssn:601-77-1192], married|social security number [ssn:410-66-9021]
IBAN [iban:DE89 3704 0044 0532 0130 00] please|pay to [iban:GB29NWBK60161331926819] soon
Call [phone:(415) 555-0199] tomorrow|Tel. [phone:555-201-4477] today|mobile [phone:07911 123456] works
The house at the end of the lane is red.|In 2015 there were 48 of 905 left.|Chapter 12, section 3 on page 48|Order 2023-1187 shipped on 2022-05-06|He was born in a village near the lake
All rights reserved by the customer.|The driver was late on Monday and the road was wet|Version 4.2.0 of the Lake Road map|Street names and numbers are missing|Dear all, the meeting is at 10:30
reference 9c1f44ab in build 771203|the passport office is closed|Mr and Mrs came too|a name is not an address|She wrote 48 pages about Willow and Oak
The and in of. Thera noch und die. Ender Anst le la. Onder the|Sector 7 of the Old Harbour opened in 1998|ratio 4:3 at 1280 x 720|token = "8F31C09A77B2D4E6119A"|ISBN 978-0-306-40615-7 is listed
"""


def sentences():
    for part in re.split(r"[|\n]", HELD_OUT.strip()):
        text, spans, at = "", set(), 0
        for m in re.finditer(r"\[([a-z]+):([^\]]*)\]", part):
            text += part[at : m.start()]
            spans.add((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        yield text + part[at:], spans


def test_precision_and_recall_on_held_out_sentences():
    read = list(sentences())
    found = [{(k.removeprefix("crf_"), a, b) for k, a, b in spans} for spans in pii.find_pii([t for t, _ in read])]
    hit, said, there = Counter(), Counter(), Counter()
    for (text, spans), own in zip(read, found, strict=True):
        for k, a, b in own:
            said[k] += 1
            hit[k] += any(k == l and a < d and c < b for l, c, d in spans)  # noqa: E741
        there.update(k for k, *_ in spans)
    figures = {k: (hit[k], said[k], there[k]) for k in there}
    print(figures)
    assert sum(hit.values()) >= 0.9 * sum(said.values()), figures
    assert sum(hit.values()) >= 0.75 * sum(there.values()), figures
    for kind, (h, s, t) in figures.items():
        assert h >= 0.5 * t and h >= 0.75 * s, (kind, figures)


def test_parts_of_longer_runs_are_nothing():
    text = 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'
    assert [s for s in pii.find_pii([text])[0] if s[0].startswith("crf_")] == []
