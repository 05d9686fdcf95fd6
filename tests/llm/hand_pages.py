"""Pages written by hand, none of them by the composer that trains the model: (name, html, main text)."""

A = "The river rose quickly after the storm, and by noon the lower fields were under water."
B = "Farmers had moved their cattle to the hills the night before. Nobody was hurt, but two barns were lost."
C = "Officials expect the level to fall by Sunday. Until then the bridge on the old road stays closed."
H = "Flood closes the old bridge"
PAGES = [
    ("body", f"<html><body><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p></body></html>", [H, A, B, C]),
    ("two divs", f"<div><div><h2>{H}</h2><p>{A}</p><p>{B}</p></div></div>", [H, A, B]),
    ("meaningless id", f"<html><body><div id=c1><p>{A}</p><p>{B}</p></div></body></html>", [A, B]),
    ("text in a div", f"<html><body><div>{A} {B}</div></body></html>", [f"{A} {B}"]),
    (
        "table as layout",
        f"<html><body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td><h1>{H}</h1><p>{A}</p><p>{B}</p></td></tr>"
        "<tr><td colspan=2>&copy; 2019 Valley Paper</td></tr></table></body></html>",
        [H, A, B],
    ),
    ("fragment", f"<h1>{H}</h1><p>{A}<p>{B}<p>{C}", [H, A, B, C]),
    ("plain text", f"{A} {B}", [f"{A} {B}"]),
    (
        "unnamed with named junk",
        f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><div><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p></div>"
        "<div class='sidebar'><h3>Most read</h3><ul><li><a href=/1>Mayor resigns</a></li><li><a href=/2>Cup final tonight</a></li></ul></div><footer>&copy; 2020 Valley Paper. All rights reserved.</footer></body></html>",
        [H, A, B, C],
    ),
    (
        "link rows around",
        f"<body><p><a href=/>Home</a> | <a href=/n>News</a> | <a href=/w>Weather</a></p><h1>{H}</h1><p>{A}</p><p>{B} See <a href=/m>the map</a> of closed roads.</p><p>{C}</p>"
        "<ul><li><a href=/a>About us</a></li><li><a href=/c>Contact</a></li></ul><p>&copy; Valley Paper</p></body>",
        [H, A, f"{B} See the map of closed roads.", C],
    ),
    (
        "blog with names",
        f"<html><body class='single sidebar-right'><div id='page'><div id='masthead' class='site-header'>Valley Paper</div><div id='primary'><div class='entry-content'><h1>{H}</h1><p>{A}</p>"
        f"<blockquote><p>{B}</p></blockquote><p>{C}</p></div></div><div class='comment-list'><p>First!</p><p>Stay safe everyone, we lost our fence too and the dog is scared.</p></div><div class='site-footer'>Imprint</div></div></body></html>",
        [H, A, B, C],
    ),
    (
        "article element",
        f"<body><header><a href=/>Valley Paper</a></header><main><article><h1>{H}</h1><p>{A}</p><ul><li>Old bridge closed</li><li>Mill road open</li></ul><p>{C}</p><div class='share-buttons'><a href=#>Share</a></div></article>"
        "<aside><h2>Related</h2><p>Last year the same road was closed for nine days.</p></aside></main><footer>Contact</footer></body>",
        [H, A, "Old bridge closed", "Mill road open", C],
    ),
    (
        "documentation",
        f"<body><div class='toc'><a href=#1>Install</a> <a href=#2>Use</a></div><div class='row'><div class='col'><h1>Gauge reader</h1><p>{A}</p><pre>gauge read --all</pre><h2>Use</h2><p>{B}</p>"
        f"<table><tr><th>flag</th><th>meaning</th></tr><tr><td>all</td><td>every gauge of the valley</td></tr></table><p>{C}</p></div></div></body>",
        ["Gauge reader", A, "gauge read --all", "Use", B, "flag", "meaning", "all", "every gauge of the valley", C],
    ),
    (
        "paragraph divs",
        f"<body><div><div><a href=/>Valley Paper</a></div><div>{A}</div><div>{B}</div><div>{C}</div><div><a href=/p>Privacy</a> <a href=/t>Terms</a></div></div></body>",
        [A, B, C],
    ),
    (
        "cookie notice and form",
        f"<body><div class='cookie-consent'><p>We use cookies to improve your experience on our pages.</p><button>Accept</button></div><section><h1>{H}</h1><p>{A}</p><p>{B}</p><p>{C}</p></section>"
        "<form><label>Mail</label><select><option>Daily<option>Weekly</select><button>Send</button></form></body>",
        [H, A, B, C],
    ),
    # fmt: off
    ("short", f"<html><body><h1>{H}</h1><p>{A}</p></body></html>", [H,A]),
    ("one word title", f"<html><body><h1>News</h1><p>{A}</p><p>Short.</p></body></html>", ["News",A,"Short."]),
    ("main-content", f"<div id='main-content'><h1>{H}</h1><p>{A}</p></div><div class='related-links'><a href=1>x</a></div>", [H,A]),
    ("story", f"<div class='site-header'><a>Home</a></div><div class='story-body'><p>{A}</p><p>{B}</p></div><div class='most-read'><ol><li><a>One thing</a><li><a>Other</a></ol></div>", [A,B]),
    ("old table", f"<center><table width=100%><tr><td bgcolor=navy><font color=white><a href=/>Home</a> <a href=/x>Links</a></font></td><td><font face=arial><b>{H}</b><br><br>{A}<br><br>{B}</font></td></tr></table></center>", [H+" "+A+" "+B]),
    ("hr address", f"<body><h2>{H}</h2>{A}<p>{B}<p>{C}<hr><address>webmaster@example.com</address></body>", [H,A,B,C]),
    ("recipe", f"<body><h1>Bread</h1><p>{A}</p><h2>You need</h2><ul><li>500 g flour</li><li>10 g salt</li><li>water</li></ul><h2>Steps</h2><ol><li>Mix the flour with the salt and the water.</li><li>Wait for a night.</li><li>Bake it hot.</li></ol></body>", ["Bread",A,"You need","500 g flour","10 g salt","water","Steps","Mix the flour with the salt and the water.","Wait for a night.","Bake it hot."]),
    ("sections", f"<body><section><h2>{H}</h2><p>{A}</p></section><section><h2>Then</h2><p>{B}</p></section></body>", [H,A,"Then",B]),
    ("role main", f"<div role=navigation><a>a</a></div><div role=main><h1>{H}</h1><p>{A}</p></div><div role=contentinfo>Imprint</div>", [H,A]),
    ("dl", f"<body><dl><dt>Ring</dt><dd>{A}</dd><dt>Field</dt><dd>{B}</dd></dl></body>", ["Ring",A,"Field",B]),
    ("wrapper ids", f"<div id=wrapper><div id=top><a href=/>Site</a></div><div id=left><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></div><div id=center><h1>{H}</h1><p>{A}</p><p>{B}</p></div><div id=bottom>&copy; 2011 Us</div></div>", [H,A,B]),
    ("wiki", f"<div id='mw-navigation'><ul><li><a>Read</a></ul></div><div id='mw-content-text'><p>{A}</p><table><tr><td>Born</td><td>1900</td></tr></table><p>{B}</p></div><div id='footer'><ul><li>Privacy</li></ul></div>", [A,"Born","1900",B]),
    ("comments unnamed tag", f"<article><h1>{H}</h1><p>{A}</p><p>{B}</p></article><section id='comments'><h3>2 comments</h3><div><b>Bob</b><p>I was there and it was terrible, the water came into our cellar at night.</p></div></section>", [H,A,B]),
    ("cjk", f"<body><h1>洪水</h1><p>昨日、川の水位が急激に上昇し、多くの農地が浸水しました。住民は避難しました。</p><p>橋は日曜日まで閉鎖されます。</p></body>", ["洪水","昨日、川の水位が急激に上昇し、多くの農地が浸水しました。住民は避難しました。","橋は日曜日まで閉鎖されます。"]),
    ("pre only", f"<body><pre>int main() {{ return 0; }}</pre></body>", ["int main() { return 0; }"]),
    ("blockquote", f"<body><p>He said:</p><blockquote>{A}</blockquote><p>{B}</p></body>", ["He said:",A,B]),
    # fmt: on
]
