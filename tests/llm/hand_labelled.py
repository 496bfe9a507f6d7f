"""Small pages and the main text that a reader takes out of them, written by hand."""


def filler() -> list[str]:
    return "the harbour office opened its doors again after a long winter and many boats came back with salted fish from northern waters while people waited on the quay".split()


A = "The harbour opened again after the winter, and the boats came back with fish."
B = "People waited on the quay for hours, and some had brought their children along."
C = "Nobody had expected so many visitors, said the harbour master on Monday morning."
D = "The council will decide in spring whether the old pier can be kept at all."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved</p></footer>"
P = lambda *x: "".join(f"<p>{t}</p>" for t in x)
LINES = lambda *x: "\n".join(x)

PAGES = [
    (f"<html><body>{NAV}<article><h1>Harbour opens</h1>{P(A, B)}</article>{FOOT}</body></html>", LINES("Harbour opens", A, B)),
    (f"<body>{NAV}<main><article>{P(A, B, C)}</article></main>{FOOT}</body>", LINES(A, B, C)),
    (f"<body><header><a href='/'>The Daily</a></header><article>{P(A)}</article></body>", A),
    (f"<body><article>{P(A)}<div class='ad'>Buy a boat today</div>{P(B)}</article></body>", LINES(A, B)),
    (f"<body><article>{P(A, B)}</article><aside><h3>Most read</h3><ul><li><a href=1>Storm</a></li></ul></aside></body>", LINES(A, B)),
    (f"<body><article>{P(A, B)}</article><section class='comments'><h3>Comments</h3>{P('I was there too!')}</section></body>", LINES(A, B)),
    (f"<body><div class='cookie-notice'><p>We use cookies on this site.</p></div><article>{P(C, D)}</article></body>", LINES(C, D)),
    (f"<body><article>{P(A)}<form><label>Mail</label><input name=m><p>Sign up</p></form>{P(D)}</article></body>", LINES(A, D)),
    (f"<body><article><h1>Pier</h1>{P(D)}<h2>Costs</h2>{P(C)}</article></body>", LINES("Pier", D, "Costs", C)),
    (f"<body><article>{P(A)}<ul><li>first boat</li><li>second boat</li></ul>{P(B)}</article></body>", LINES(A, "first boat", "second boat", B)),
    (f"<body><article>{P(A)}<blockquote>{C}</blockquote></article>{FOOT}</body>", LINES(A, C)),
    ("<body><article><p>Fish &amp; chips &#8211; caf&eacute;   at\n\tthe <b>old</b> <i>pier</i></p></article></body>", "Fish & chips \u2013 caf\u00e9 at the old pier"),
    (f"<body><article><script>var p = '<p>no</p>';</script>{P(A)}<style>p {{ color: red }}</style></article></body>", A),
    (f"<body><!-- <p>old</p> --><article>{P(B)}</article></body>", B),
    (f"<body>{NAV}<article><p>{A}<p>{B}</article>{FOOT}", LINES(A, B)),
    (f"<body><article>{P(A)}<div class='related'><ul><li><a href=1>More boats</a></li><li><a href=2>More fish</a></li></ul></div></article></body>", A),
    (f"<body><div class='banner'><p>Sale now on</p></div><article>{P(A, D)}</article><div class='newsletter'><p>Get our letter</p></div></body>", LINES(A, D)),
    (f"<body>{NAV}<div class='content'><h1>Quay</h1>{P(A, B, C)}</div>{FOOT}</body>", LINES("Quay", A, B, C)),
    (f"<body>{NAV}<div class='post'>{P(B, C)}</div><div class='sidebar'><p>About the author of this page</p></div></body>", LINES(B, C)),
    (f"<body><article><table><tr><td>boats</td><td>42</td></tr></table>{P(D)}</article></body>", LINES("boats", "42", D)),
    (f"<body><article><p>{A}<br>{B}</p></article></body>", f"{A} {B}"),
    (f"<body><article>{P(A)}<aside><p>Read this other story next</p></aside>{P(B)}</article></body>", LINES(A, B)),
    (f"<body><div class='menu'><a href=1>One</a> <a href=2>Two</a></div><article>{P(C)}</article></body>", C),
    (f"<body><article>{P(A)}</article><div class='comments'><div class='comment'>{P('Nice.')}</div><div class='comment'>{P('Not so nice, I think.')}</div></div>{FOOT}</body>", A),
    (f"<body><div class='warning'><p>Your browser is old.</p></div>{NAV}<article><h1>Winter</h1>{P(A)}</article></body>", LINES("Winter", A)),
    (f"<body><article><h1>\u6e2f\u53e3</h1>{P('\u5192\u3059\u6d77\u306e\u6e2f\u304c\u518d\u3073\u958b\u3044\u305f\u3002')}</article>{FOOT}</body>", "\u6e2f\u53e3\n\u5192\u3059\u6d77\u306e\u6e2f\u304c\u518d\u3073\u958b\u3044\u305f\u3002"),
    (f"<body>{NAV}{FOOT}</body>", ""),
    (f"<body><article>{P(A)}<p></p><p>   </p>{P(B)}</article></body>", LINES(A, B)),
    (f"<body><article>{P(A, A)}</article></body>", LINES(A, A)),
    (f"<BODY><ARTICLE><P>{A}</P></ARTICLE><FOOTER>me</FOOTER></BODY>", A),
    (f"<body><article>{P(A)}<div class='advert'><p>Cheap engines for sale</p></div></article><div class='promo'><p>Win a trip</p></div></body>", A),
    (f"<body><article>{P(B)}<pre>tide 04:10 1.2 m</pre></article></body>", LINES(B, "tide 04:10 1.2 m")),
]
