"""Fixed values of the HTML standard, as the engine needs them."""

from __future__ import annotations

SPACE = "\t\n\f\r "


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Element categories.
VOID = words("area base br col embed hr img input link meta param source track wbr")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
FORMATTING = words("a b big code em font i nobr s small strike strong tt u")
# Fixed values, of this engine and not of the standard: what a body may hold that a frameset replaces.
FRAMESET_BODY = FORMATTING | words("div figure p param source track")
SPECIAL = words(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dialog"
    " dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img"
    " input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search"
    " section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr"
)
IMPLIED_END = words("dd dt li option optgroup p rb rp rt rtc")
SCOPE = words("applet caption html table td th marquee object select template")
RAWTEXT = words("style xmp iframe noembed noframes")
RCDATA = words("title textarea")
CLOSES_P = words(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol"
    " p search section summary ul"
)
BLOCK_END = CLOSES_P - {"p"} | words("button listing pre select")
# Fixed values, of this engine and not of the standard: where white space stays, where blocks trim it, and whose text is written raw.
PRESERVE_SPACE = words("code pre script style textarea")
TRIM_BLOCKS = words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup html hr li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
RAW_OUTPUT = words("script style iframe noembed noframes plaintext xmp")
FOREIGN_BREAKOUT = words(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby"
    " s small span strong strike sub sup table tt u ul var"
)
MATH_TEXT = words("mi mo mn ms mtext")
SVG_HTML = words("foreignObject desc title")
SVG_TAGS = {
    t.lower(): t
    for t in words(
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix"
        " feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feFlood feFuncA feFuncB"
        " feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight"
        " feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath"
    )
}
SVG_ATTRS = {
    t.lower(): t
    for t in words(
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef"
        " gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle"
        " markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform"
        " patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur"
        " requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles"
        " surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
    )
}
# Namespaced attributes of foreign elements, shown as "prefix name".
FOREIGN_ATTRS = {a: a.replace(":", " ") for a in words("xlink:actuate xlink:arcrole xlink:href xlink:role xlink:show xlink:title xlink:type xml:lang xml:space xmlns:xlink")}
# Public and system identifiers that put a document in quirks mode.
QUIRKS_PUBLIC = (
    "-//w3o//dtd w3 html strict 3.0//en//",
    "-/w3c/dtd html 4.0 transitional/en",
    "html",
)
QUIRKS_SYSTEM = ("http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd",)
QUIRKS_PREFIXES = (
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)
LIMITED_PREFIXES = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
HTML4_PREFIXES = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
# What numeric references to C1 controls stand for (Windows-1252).
C1 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
