"""The hand-labelled part of operator 4's table: lines in which ``[[kind:text]]`` marks a span."""

from __future__ import annotations

import re

LINES = """
Please call [[phone:(415) 555-0134]] before noon, the desk closes early on Fridays.
For support dial [[phone:212-555-0187]] or write to us by post.
Tel: [[phone:020 7946 0958]], ask for the night porter.
My new mobile is [[phone:0161 496 0000]] and the old one no longer works.
Contact the clinic at [[phone:604.555.0123]] for an appointment.
Fax [[phone:(303) 555-0199]] all forms by 5 pm on 12 March 2019.
You can reach Dana on [[phone:555-867-5309]] after 18:30.
He left a number, [[phone:+44 20 7946 0102]], and hung up.
Phone [[phone:030 1234 5678]] zwischen 9 und 17 Uhr.
Appelez le [[phone:01 23 45 67 89]] pour toute question.
Llame al [[phone:(91) 555 0123]] de lunes a viernes.
Hotline [[phone:1-800-555-0142]] is free of charge.
export API_KEY=[[secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]]
token = "[[secret:c4ca4238a0b923820dcc509a6f75849b]]" # do not commit
password: [[secret:xK29vLq8Zr41TnB7mWc3Yd05]] and please rotate it
Authorization: Bearer [[secret:eyJhbGciOiJIUzI1NiJ9abc123DEF456ghi789]]
secret=[[secret:A7f3Kd92LmQ84xYz10PvRt56]] in the old config file
api key: [[secret:d41d8cd98f00b204e9800998ecf8427e]] (expired)
The access token [[secret:7b52009b64fd0a2a49e6d8a939753077792b0554]] leaked in a log.
aws_secret_access_key = [[secret:wJalrXUtnFEMI7K7MDENGbPxRfiCYEXAMPLEKEY12]]
client_secret: '[[secret:Zx81Qm27Lp09Vb64Tn35Ks12Hd]]'
The war of 1939-1945 cost more than 60,000,000 lives.
Version 2.14.3 was released on 2021-06-30 at 14:05.
Order 4587123 ships in 3-5 days for 49.99 including 20% tax.
See pages 112-118 and table 7.2 of the 1998 edition.
The sum of 1,234,567.89 was paid in 12 instalments.
ISBN 978-3-16-148410-0 is out of print.
Room 404, building 12, 3rd floor, zone B-7.
Flight BA2490 leaves at 06:45 from gate 23.
The sequence is 1 2 3 5 8 13 21 34 55 89 and so on.
He scored 103, 98, 112 and 87 in four games.
Population 8,336,817 (2020), up 2.1% since 2010.
Model XJ-900 has 16 GB and a 512 GB disk, part no 100-2345-6.
GPS 51.5074, -0.1278 marks the spot.
The key to success is patience and 10,000 hours of work.
A token of 3 coins was the fee in 1780.
His secret was 40 minutes of sleep at 15:00.
Invoice 2023-0001745 dated 04/11/2023, net 30 days.
The string deadbeef is a joke among engineers, 0xdeadbeef too.
Article 12(3) of Regulation 2016/679 applies.
SHA-1 gives 160 bits, MD5 gives 128.
Section 4.3.2.1 explains chapters 5 to 9.
The call lasted 45 minutes and cost 3.20.
Password must have 8 to 64 characters and 1 digit.
Temperatures of -12 to +35 degrees are normal.
The 7-day average fell to 1.02 from 1.15.
Odds of 5/2, 11-4 and 100-30 were offered.
Lot 88-104 of 2,500 units was recalled in May 2018.
""".strip().split("\n")

_MARK = re.compile(r"\[\[(phone|secret):(.*?)\]\]")


def parsed(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A line without its marks, and its spans."""
    out, spans, at = "", [], 0
    for m in _MARK.finditer(line):
        out += line[at : m.start()]
        spans.append((m[1], len(out), len(out) + len(m[2])))
        out += m[2]
        at = m.end()
    return out + line[at:], spans
