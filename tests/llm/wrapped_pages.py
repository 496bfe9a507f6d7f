"""Pages whose article lies in elements with misleading names, in forms, or in
plain divisions, and what a reader takes out of them: written by hand, each
surrounding with each article."""

from hand_labelled import FOOT, LINES, NAV, A, B, C, D

HEAD = "Harbour opens again"
#: (html, text) of articles.
ARTICLES = [
    (f"<main><h1>{HEAD}</h1><p>{A}</p><p>{B}</p><p>{C}</p></main>", LINES(HEAD, A, B, C)),
    (f"<div class='content'><h1>{HEAD}</h1><p>{A}</p><p>{B} {C}</p><p>{D}</p></div>", LINES(HEAD, A, f"{B} {C}", D)),
    (f"<article><p>{A}</p><h2>What is next</h2><p>{D}</p><p>{C}</p></article>", LINES(A, "What is next", D, C)),
    (f"<div class='c1'><h1>{HEAD}</h1><div class='t'>{A}</div><div class='t'>{B}</div><div class='t'>{C}</div></div>", LINES(HEAD, A, B, C)),
    (f"<div class='sc-x7'><h1>{HEAD}</h1><div class='css-k2'>{C}</div><div class='css-k2'>{D}</div><div class='css-k2'>{A} {B}</div></div>", LINES(HEAD, C, D, f"{A} {B}")),
]
ASIDE = "<aside class='sidebar'><h3>More</h3><ul><li><a href='/a'>Tide tables</a></li><li><a href='/b'>Fish prices</a></li></ul></aside>"
REMARKS = "<section class='comments'><div class='comment'><p>What a lovely day that was.</p></div></section>"
COOKIES = "<div class='cookie-notice'><p>We use cookies to improve this site.</p></div>"
#: What stands around an article, marked @.
AROUND = [
    f"<body>{NAV}<div class='layout with-sidebar'>@{ASIDE}</div>{FOOT}</body>",
    f"<body><form id='aspnetForm'>{NAV}@</form>{FOOT}</body>",
    f"<body class='has-sidebar nav-open'>{NAV}@{FOOT}</body>",
    f"<html><head><title>x</title></head><body><div class='header-fixed'>@</div>{ASIDE}</body></html>",
    f"<body>{COOKIES}<div id='page' class='banner-on'>{NAV}@{ASIDE}{FOOT}</div></body>",
    f"<body>{NAV}<div class='widget-area social-on'>@{REMARKS}</div></body>",
    f"<body><div class='wrap'><div class='col'>@</div><div class='col'>{ASIDE}</div></div>{FOOT}</body>",
    f"<body>{NAV}<form action='/post'><div class='modal-ready'>@</div></form>{REMARKS}{FOOT}</body>",
    f"<body><fieldset>@</fieldset>{FOOT}</body>",
    f"<body><div class='promo-week'>{NAV}<div>@</div></div>{COOKIES}</body>",
    f"<body>{NAV}<section class='related-on login-off'>@</section>{ASIDE}{FOOT}</body>",
    f"<div class='share-bar-on'>@</div>{FOOT}",
]
PAGES = [(page.replace("@", body), text) for page in AROUND for body, text in ARTICLES]
