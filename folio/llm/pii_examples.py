"""A small labelled table: sentences whose personal data is marked, in forms that plain patterns miss or must not find."""

EXAMPLES = (
    "call me at <phone>(212) 555-0188</phone> after lunch",
    "Tel. <phone>030 1234567</phone> or write to the office",
    "phone: <phone>212-555-0147</phone>",
    "Phone <phone>555.010.2233</phone>, ask for the manager",
    "fax <phone>(0)89 4567 8901</phone> only in the morning",
    "mobile <phone>0171 2345678</phone>",
    "Mobil: <phone>0151/23456789</phone> bitte nur abends",
    "Telefon <phone>030/901820</phone> Zimmer 12",
    "tel <phone>01 42 68 53 00</phone> du lundi au vendredi",
    "appelez le <phone>06.12.34.56.78</phone> avant midi",
    "you can reach us on <phone>0044 20 7946 0958</phone>",
    "rufen Sie <phone>0049 30 1234567</phone> an",
    "her number is <phone>(415) 555 0132</phone> and his is <phone>(415) 555 0199</phone>",
    "call <phone>1-800-555-0199</phone> now!",
    "call <phone>800 555 0175</phone> now",
    "order at <phone>1-888-555-0123</phone> or online",
    "office <phone>202.555.0175</phone>, second floor",
    "fax <phone>040/765432</phone>",
    "phone <phone>617-555-0110</phone> 24 hours a day",
    "ring <phone>020 7946 0321</phone> for help",
    "text me: <phone>555-0123</phone>",
    "my cell is <phone>(303) 555-0164</phone>.",
    "contact <phone>(02) 5550 4321</phone> in Sydney",
    "please dial <phone>011 44 161 496 0321</phone>",
    "phone <phone>+1 (487) 555-7209</phone> is listed",
    "and <phone>+49 30 901820</phone> is the other one",
    "or <phone>+33 1 42 68 53 00</phone> in Paris",
    "the card <card>4111.1111.1111.1111</card> was declined",
    "card <card>4012/8888/8888/1881</card> exp 04/27",
    "pay with <card>5555.5555.5555.4444</card> today",
    "visa <card>4111 1111 1111 1111</card> on file",
    "Visa: <card>4012-8888-8888-1881</card>",
    "amex <card>3782 822463 10005</card> is hers",
    "number <card>4736962573099581</card> belongs to him",
    "mastercard <card>5105 1051 0510 5100</card> expired in 2019",
    "card no. <card>6011_1111_1111_1117</card>",
    "cards <card>4111111111111111</card> <card>5555555555554444</card> and <card>4012888888881881</card>",
    "both <card>6011111111111117</card> <card>4111111111111111</card> expired",
    "to <email>ann@example.com</email> <email>tim@example.org</email> only",
    "hosts <ip>192.0.2.5</ip> <ip>198.51.100.7</ip> <ip>203.0.113.77</ip> failed",
    "kartennummer <card>4111.1111.1111.1111</card> bis 12/26",
    "write to <email>jane.doe(at)example.org</email> please",
    "mail <email>info[at]example.com</email> for a quote",
    "email: <email>sales(at)example.net</email>",
    "Mail an <email>max.mustermann(at)example.de</email> genügt",
    "contact <email>support[at]mail.example.org</email>",
    "or <email>jane_doe(at)example.co.uk</email> at work",
    "ask <email>root@localhost</email> about it",
    "mail <email>admin@intranet</email>",
    "from <email>bob@example.com</email> to <email>eve@example.net</email>",
    "under.34 <email>x.34@mail7.example.com</email> ends it",
    "e-mail <email>team(at)example.io</email>, thanks",
    "écrivez à <email>contact(at)example.fr</email> ou passez",
    "host <ip>2001:db8::ff00:42:8329</ip> answers",
    "from <ip>fe80::1ff:fe23:4567:890a</ip> port 22",
    "address <ip>2001:0db8:85a3:0000:0000:8a2e:0370:7334</ip>",
    "server <ip>::ffff:192.0.2.128</ip> is down",
    "ping <ip>2001:db8:0:1::1</ip> failed",
    "blocked <ip>2a00:1450:4001:81b::200e</ip> again",
    "ip <ip>192.0.2.17</ip> logged in",
    "login from <ip>198.51.100.23</ip> at 10:42",
    "client <ip>203.0.113.9</ip>, client <ip>203.0.113.10</ip>",
    "on 2024-01-15 at 12:30 we met",
    "released 12/31/2019 as version 1.2.3",
    "version 4.0. is out, see section 3.1",
    "the price is $1,299.00 or 1.299,00 EUR",
    "ISBN 978-3-16-148410-0 and ISSN 2049-3630",
    "pages 10-20 and 112-118, chapter 7",
    "order 20240115 was sent in 3 parts",
    "in 1999 2000 and 2001 sales rose by 12% 15% and 18%",
    "the score was 3-2 after 90 minutes",
    "see [12] and [13-15] for (1) and (2)",
    "C++ and a+b=c or 3+4=7",
    "follow @home and @work in 2023",
    "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixes 1021",
    "at 52.5200 13.4050 the temperature is 21.5",
    "id 123456789012345 of table 17",
    "serial 1234567890123456789012 in box 4",
    "pi is 3.14159265358979 and e is 2.718281828",
    "row 1 2 3 4 5 6 7 8 9 10 11 12",
    "from 08:00 to 17:30, room 204 (2nd floor)",
    "build 10.0.19045 of kernel 5.15.0-91",
    "size 1024x768 at 60Hz",
    "invoice 2023/0042 due 01.02.2024",
    "Am 03.10.1990 um 12 Uhr",
    "zip 10115 Berlin, 75001 Paris, 02139 Cambridge",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" in line 3",
    "(see above) [citation needed] (a) (b)",
    "1,000,000 users and 2,500 servers",
    "MAC 00:1B:44:11:3A:B7 of device 9",
    "16:9 or 4:3, ratio 1:2:3",
    "x = f(x1, x2) + g(3)",
    "§ 12 (3) and Art. 5(1)",
    "1st, 2nd and 3rd of 100",
    "GPU 4090, 24GB, driver 535.54.03",
)
