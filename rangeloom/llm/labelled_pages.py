"""Labelled pages on which the content model is trained.

Each is written out by hand in a few lines.  An element with ``y`` (and what it holds) is content, one with ``n`` isn't;
the innermost mark counts, and pages start unmarked, that is without content.  ``@`` stands for a sentence, ``~`` for a
short phrase such as a link's text; the trainer fills them with sentences and phrases of varying length.
"""

PAGES = [
    """<body><nav><ul><li><a>~</a></li><li><a>~</a></li><li><a>~</a></li><li><a>~</a></li></ul></nav><div class="ad">@</div>
    <article y><h1>~</h1><p>@ @</p><p>@</p><p>~</p><p>@ @ @</p></article><footer>~ @</footer></body>""",
    """<body><nav><a>~</a> <a>~</a> <a>~</a></nav><div class="ad">@ @</div><article y><h1>~</h1><p>~</p><p>~</p><p>~</p></article><footer>@ @</footer></body>""",
    """<body><div class="ad banner">@</div><article y><h1>~</h1><p>@<a>~</a> @</p><p>@ @</p><div class="ad" n>@</div><p>@</p><ul><li>~</li><li>@</li></ul><p>@</p>
    <section class="comments" n><h3>~</h3><div class="comment"><p>@ @</p></div><div class="comment"><p>@</p></div></section></article><footer>~</footer></body>""",
    """<body><header><h1>~</h1><p>~</p><ul><li><a>~</a></li><li><a>~</a></li></ul></header><main y><h2>~</h2><p>@ @</p><blockquote><p>@</p></blockquote><p>@ @</p></main>
    <aside><h4>~</h4><ul><li><a>~</a></li><li><a>~</a></li></ul><p>@</p></aside><footer><p>~</p><p>@</p></footer></body>""",
    """<body><div id="header"><a>~</a></div><div id="menu"><ul><li><a>~</a></li><li><a>~</a></li><li><a>~</a></li></ul></div><div id="content" y><h1>~</h1><p>@ @ @</p>
    <h2>~</h2><p>@</p><p>@ @</p><table><tr><td>~</td><td>~</td></tr><tr><td>~</td><td>@</td></tr></table><p>@</p></div><div id="sidebar"><p>@</p><a>~</a></div><div id="footer">~</div></body>""",
    """<body><div class="cookie-notice"><p>@ @</p><button>~</button></div><div class="topbar"><a>~</a><a>~</a></div><div class="post-body" y><p>@ @</p><p>@</p><pre>@</pre><p>@ @ @</p></div>
    <div class="share"><a>~</a><a>~</a></div><div class="related-posts"><h3>~</h3><p><a>~</a></p><p><a>~</a></p></div><div id="comments"><p>@</p><p>@ @</p></div></body>""",
    """<body><div class="wrapper"><div class="nav-menu"><a>~</a><a>~</a><a>~</a></div><div class="story" y><h1>~</h1><div><p>@</p><p>@ @</p></div><p>@</p><div class="promo" n><p>@</p></div><p>@ @</p>
    <div class="newsletter-signup" n><form><p>@</p><input><button>~</button></form></div><p>@</p></div><div class="widget"><p>@</p></div></div><footer><ul><li><a>~</a></li></ul></footer></body>""",
    """<body><header><nav><a>~</a><a>~</a></nav></header><div class="alert notice">@</div><section><article y><header><h1>~</h1><p>~</p></header><p>@ @ @</p><p>@</p><figure><figcaption>@</figcaption></figure><p>@ @</p>
    <footer n><a>~</a> ~</footer></article></section><form><label>~</label><input><select><option>~</option></select></form><aside><p>@</p></aside></body>""",
    """<body><div id="nav"><a>~</a></div><div id="main"><div class="entry-content" y>@ @<p>@</p><p>@ @</p><ol><li>@</li><li>@</li></ol>@</div><div class="comment-list"><div><p>@</p></div><div><p>@ @</p></div></div></div>
    <div class="copyright">~ @</div></body>""",
    """<body><p class="breadcrumb"><a>~</a> <a>~</a></p><div class="article-text" y><p>@ @</p><h3>~</h3><p>@</p><p>~</p><dl><dt>~</dt><dd>@</dd></dl></div><div class="sponsored"><p>@ @</p></div>
    <div class="social"><a>~</a><a>~</a></div><div class="footer-links"><a>~</a><a>~</a></div></body>""",
    """<body><div class="subscribe-banner"><p>@</p></div><table class="layout"><tr><td class="left-menu"><a>~</a><a>~</a></td><td y><h1>~</h1><p>@ @</p><p>@</p><p>@ @ @</p></td></tr></table><div class="disclaimer">@</div></body>""",
    """<body><main><article y><h1>~</h1><p>@</p><aside n><p>@</p><p>@</p></aside><p>@ @</p><nav n><a>~</a><a>~</a></nav><p>@</p></article></main><div class="ads"><p>@</p></div><footer>~</footer></body>""",
    """<body><nav><ul><li><a>~</a></li><li><a>~</a></li></ul></nav><div class="ad">~</div><article y><h1>~</h1><p>@</p></article><footer>~</footer></body>""",
    """<body><nav><ul><li><a>~</a></li></ul></nav><div class="ad">@</div><article y><p>~</p></article><footer>@ @ @</footer></body>""",
    """<body y><h1>~</h1><p>@ @</p><p>@</p><p>@ @ @</p><p>~</p></body>""",
    """<body><div><a>~</a><a>~</a><a>~</a></div><div y><p>@ @ @</p><p>@ @</p><p>@ @ @</p></div><div><p>~ <a>~</a></p></div></body>""",
    """<body><div class="modal popup"><p>@</p><button>~</button></div><div class="text" y><h2>~</h2><p>@ @</p><p>@</p></div><div class="login"><form><input><p>~</p></form></div><div class="tags"><a>~</a><a>~</a></div></body>""",
    """<body class="home has-sidebar"><div class="page-wrap comment-open"><div class="top-bar"><a>~</a> <a>~</a></div><article y><h1>~</h1><p>@ @</p><p>@</p><p>@ @</p></article><div class="footer"><a>~</a><p>@</p></div></div></body>""",
    """<body><div id="wrapper" class="sidebar-right comments-closed"><div class="navMenu"><a>~</a><a>~</a><a>~</a></div><main y><h1>~</h1><p>@ @</p><p>@ @ @</p><ul><li>@</li><li>~</li></ul><p>@</p></main>
    <div class="sideBar"><p>@</p></div></div><div class="cookieBanner"><p>@ @</p></div></body>""",
    """<body><div class="site header-fixed"><div id="siteHeader"><p>~</p><a>~</a></div><div class="content-area"><div class="post-content" y><p>@</p><p>@ @</p><blockquote>@</blockquote><p>@ @</p></div></div><div class="relatedLinks"><a>~</a><a>~</a></div></div></body>""",
    """<body><div class="layout with-nav"><nav><a>~</a><a>~</a></nav><article y><h2>~</h2><p>@</p><p>~</p></article><section class="reader-comments"><div class="comment-body"><p>@ @</p></div><div class="comment-body"><p>@ @ @</p></div><div class="comment-body"><p>@</p></div></section></div></body>""",
    # short articles, alone on their page or nearly so
    """<body y><p>@</p></body>""",
    """<body y><p>@ @ @ @</p></body>""",
    """<body y><h1>~</h1><p>@ @ @</p></body>""",
    """<body y>@ @</body>""",
    """<body><main y><p>@</p></main></body>""",
    """<body><main y><h1>~</h1><p>@ @ @</p></main><footer>~</footer></body>""",
    """<body><div class="page" y><p>@</p></div></body>""",
    """<body><div y><h2>~</h2><p>@ @ @ @</p></div></body>""",
    """<body><article y><p>@ @</p></article></body>""",
    """<body><nav><a>~</a></nav><div y><h1>~</h1><p>@</p><p>@ @ @</p></div><footer>~</footer></body>""",
    """<body><nav><a>~</a><a>~</a></nav><div y><p>@</p></div><footer>@</footer></body>""",
    """<body><ul class="menu"><li><a>~</a></li><li><a>~</a></li></ul><p y>@ @</p><div class="footer">~</div></body>""",
    """<body><header><a>~</a></header><h1 y>~</h1><p y>@ @ @ @ @</p><footer><p>@</p></footer></body>""",
    """<body><div id="nav"><a>~</a><a>~</a></div><h2 y>~</h2><p y>@</p><p y>@</p><div class="copyright">~</div></body>""",
    """<body><nav><a>~</a></nav><section y><h1>~</h1><p>@ @ @</p></section><aside><p>@</p></aside></body>""",
    """<body><div class="cookie-banner"><p>@ @</p></div><main y><h1>~</h1><p>@</p></main></body>""",
    """<body><div><div y><p>@ @</p></div></div><div class="comments"><p>@</p><p>@ @ @</p></div></body>""",
    """<body><form><p>~</p><input></form><div y><h1>~</h1><p>@ @</p></div><div class="related"><a>~</a></div></body>""",
    """<body><nav><a>~</a><a>~</a><a>~</a></nav><footer>~ @</footer></body>""",
    """<body><div class="menu"><a>~</a><a>~</a></div><div class="login"><form><p>~</p></form></div><div class="notice">@</div></body>""",
]
