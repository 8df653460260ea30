"""Held-out sentences with personal data that the base patterns miss, written by hand; nothing is
trained on them, but the training table was widened while looking at the first lot.

``⟦kind|item⟧`` marks an item.
"""

import re

WRITTEN = """
Please send your CV to ⟦email|maria (at) firma (dot) de⟧ before Friday.
You can write to ⟦email|jan.kowalski (at) example (dot) com⟧ for tickets.
My address is ⟦email|anna at mail dot com⟧, thanks!
Contact: ⟦email|anna AT mail DOT com⟧
Reach the office at ⟦email|office [at] my-company [dot] org⟧ or by post.
Fragen an ⟦email|info [at] verein-nord [dot] de⟧ richten.
For details, ⟦email|support(at)shop24(dot)eu⟧ is the best place.
Questions? ⟦email|j.doe [at] x.org⟧ will answer.
Mail ⟦email|bob.stone (at) example (dot) org⟧ about the flat.
Schreib an ⟦email|k_meier (at) web (dot) de⟧.
Escribe a ⟦email|lucia.perez [at] correo [dot] es⟧ si tienes dudas.
Écrivez à ⟦email|contact (at) mairie-lyon (dot) fr⟧ pour en savoir plus.
The list owner is ⟦email|owner {at} lists {dot} example {dot} net⟧.
Press: ⟦email|press [at] museum.org⟧
Old mail: ⟦email|tom99 at yahoo dot com⟧ and new mail: ⟦email|tom.b (at) posteo (dot) net⟧.
For the keys ask ⟦email|house-7 (at) keys (dot) co (dot) uk⟧ first.
write me: ⟦email|sarah.lee (AT) uni (DOT) edu⟧
To unsubscribe, mail ⟦email|leave at news dot example dot com⟧ once.
⟦email|hr (at) big-bank (dot) com⟧ handles all applications.
He signed as ⟦email|ghost [at] inbox [dot] io⟧ and left.
Ruf mich unter ⟦phone|0170-1234567⟧ an.
Büro: ⟦phone|0711/1234567⟧, Montag bis Freitag.
Telefon ⟦phone|030 1234567⟧ oder per Fax.
Call ⟦phone|(555) 123-4567⟧ after six.
You can text ⟦phone|555-867-5309⟧ any time.
Tel.: ⟦phone|089 / 55 44 33 22⟧
Mobil ⟦phone|0151 23456789⟧
Notruf der Hausverwaltung: ⟦phone|0221-998877-12⟧.
Appelez le ⟦phone|06 12 34 56 78⟧ ce soir.
Téléphone : ⟦phone|01-45-67-89-10⟧
London office, ⟦phone|020 7946 0958⟧, ask for Jim.
Toll free ⟦phone|1-800-555-0199⟧ from anywhere.
From abroad dial ⟦phone|0049 30 9876543⟧ please.
Llame al ⟦phone|912 345 678⟧ por la tarde.
Reservations: ⟦phone|212.555.0147⟧
The plumber (⟦phone|07700 900123⟧) comes tomorrow.
Fax ⟦phone|(0211) 4567890⟧
Her cell is ⟦phone|415 555 2671⟧ I think.
WhatsApp ⟦phone|0176-555-44-333⟧
Kontakt unter ⟦phone|04321/98765-0⟧ möglich.
The meeting is on 2024-03-15 at 10:30 in room 204.
Order 123456789012 was shipped on 12/11/2023.
ISBN 978-3-16-148410-0 is out of print.
The population grew from 1,234,567 to 2,345,678 in 2010-2020.
Version 10.4.2.1337 fixed the bug at line 120345.
Look at the dot on the map, then turn left at 5.
Invoice 2023-000451-77 is due in 30 days.
Between 1990 and 2005 it cost 12.500.000 euros.
Coordinates 52.520008, 13.404954 mark the spot.
We met at noon; the dot matrix printer was at home.
Article 12 345 678 of the archive, page 90.
The serial number is 000123456789AB.
In 1999 2000 and 2001 the score was 3 2 1.
It weighs 1 250 000 000 kilograms in total.
The code 20240115103000 is a time stamp.
Follow @someone and #topic1234 for news at 8.
Chapter 3.2.1 covers pages 100-250.
Total: $1,299.00, tax 19% and 45.50 for shipping.
"""


#: Written after the training table was widened. One item was not found whole then; later only longer words were added.
LATER = """
If lost, return to ⟦email|nina_b (at) gmx (dot) net⟧, reward given.
The editor is ⟦email|mark.twain at river dot org⟧ since May.
Bewerbungen nur per Mail: ⟦email|jobs [at] baecker-schmidt [dot] de⟧
Send bugs to ⟦email|bugs(at)tracker(dot)info⟧!
⟦email|ceo [AT] startup [DOT] io⟧ wrote back within the hour.
Pour toute question, ⟦email|aide {at} logiciel {dot} fr⟧ répond vite.
Lost cat, please ring ⟦phone|01632 960 001⟧ or knock.
Die Praxis hat die Nummer ⟦phone|0431 / 123 45 67⟧.
Hotline ⟦phone|0800-1234567⟧ (free of charge)
Text me at ⟦phone|(212) 867-5309⟧ when you land.
Cabinet médical, ⟦phone|04 78 12 34 56⟧, sur rendez-vous.
New number: ⟦phone|646.555.0188⟧
He lives at the corner and sells dot paintings for 1500 euros.
Flight LH 1234 left at 18:45 from gate 22, seat 14.
The 1995-1999 series had 120 000 copies printed.
Room 0123 is on floor 4, building 56.
Bitte 2 500 g Mehl und 0,75 l Milch kaufen.
Case no. 4-2023-118 was heard on 05/06/2023.
"""


#: Items that a reader of the round before named as missed or kept, and the false one; the table was widened while looking at these.
NAMED = """
mail ⟦email|ops (at) example.org⟧ now
write to ⟦email|kim (at) mail (dot) example (dot) com⟧ soon
write to ⟦email|anna at mail.com⟧ please
frag ⟦email|sara AT posteo.de⟧
contact ⟦email|lena at uni-koeln.de⟧ for it
mail ⟦email|Anna At Mail Dot Com⟧
Mail an ⟦email|info[@]shop.de⟧
reach ⟦email|joe @ example . com⟧ there
mail ⟦email|peter_at_firma_dot_de⟧ bitte
call ⟦phone|0800 123 456⟧ today
ring ⟦phone|01632 960 983⟧
dial ⟦phone|1 (800) 555 0199⟧ now
Telefon ⟦phone|030/123 45 67⟧
mobil ⟦phone|0160 / 9988 776⟧
tel ⟦phone|612-345-678⟧
mon numéro ⟦phone|0612345678⟧ merci
call me ⟦phone|9876543210⟧
tel ⟦phone|22 33 44 55 6⟧
ISBN 0-306-40615-2 is out
"""

#: Written after that and scored once.
UNSEEN = """
Send the draft to ⟦email|helen at uni-bonn.de⟧ by noon.
Ask ⟦email|paul_at_werkstatt_dot_de⟧ for the key.
My new mail is ⟦email|rita [@] posteo.net⟧, the old one is dead.
Contact: ⟦email|Desk At Paper Dot Org⟧
Bitte an ⟦email|vorstand (at) chor-west.de⟧ schreiben.
Escribe a ⟦email|marta at correo.es⟧ hoy mismo.
Mail ⟦email|o.brien {at} press {dot} ie⟧ first.
Write to ⟦email|team at startup dot io⟧ for a demo.
Appelez mon numéro ⟦phone|0678901234⟧ demain.
Call ⟦phone|8005550147⟧ toll free.
Die Nummer ist ⟦phone|0172 55 66 77 8⟧ .
Telefon: ⟦phone|040/34 56 78⟧
Ring ⟦phone|01865 270 100⟧ and ask for Ann.
Tel. ⟦phone|(06221) 54 32 10⟧
Llame al número ⟦phone|934 567 890⟧ ahora.
Fax ⟦phone|0341-9 73 51 00⟧
We looked at example.org and found nothing.
The band played at noon. Com is not a word.
ISBN 3-16-148410-0 was printed twice.
Ticket 1234567890 is still open.
The team arrived at 8 and left at 10.30 sharp.
In 2019 12 345 visitors came, in 2020 only 678.
The file my_photo_at_home_dot_jpg is lost.
Invoice 0012345678 was paid in May.
"""


def written(lines: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts and their spans."""
    out = []
    for line in filter(None, lines.split("\n")):
        text, spans, at = "", [], 0
        for m in re.finditer("⟦(email|phone)[|](.*?)⟧", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
