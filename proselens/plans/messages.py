"""What each rule says of a finding, and what may be done about it: `code|message|fix`, a line a rule."""

from __future__ import annotations

_RAW = """
001|code was left out behind a comment|write out the code that the comment stands for
002|a chat reply's opening words are in the code|delete the words
003|a Markdown fence stands in the source|delete the fence line
004|a comment names a tool as the author|delete the note, or say what the code does
005|the handler swallows the error|handle the error, or pass it on
006|the except clause catches everything|name the exceptions that are expected
007|a cast switches the type checker off|give the value its own type
008|the body is a stub|write the body, or remove the function
009|a sample value stands where a real one belongs|read the value from the configuration
010|the package isn't among the dependencies|add it to the manifest, or remove the import
011|words of an assistant's reply are left in the text|delete them
012|a tool's token is left in the text|delete the token
013|a template's blank isn't filled in|fill in the blank
014|a worn phrase|say it plainly
015|hedges are many for this length|keep the hedges that are needed
016|words that models overuse are many for this length|use plainer words
017|the same figure of contrast or trailing clause recurs|vary the sentences
018|a dash in mid-sentence|use a comma, a colon or two sentences
019|bold type is overused|keep bold for what must be found
020|quotation marks are typographic|use straight ones
021|headings follow a formula|use sentence case, and merge thin sections
022|a formulaic opener|begin with the point
023|a thing is defined by what it isn't|say what it is
024|the importance is asserted|say what changed, with figures
025|a claim without a source|name the source
026|a colon builds up to a reveal|make one sentence of it
027|filler words are many for this length|delete them
028|weak verb phrases or vague amounts|use one verb, or give the number
029|the ending repeats or preaches|end with the last fact
030|fragments, or sentences of one rhythm|join or vary the sentences
031|the language of advertising|describe instead
032|hyphenated compounds are many for this length|use plainer words
033|the sentence is overlong|make two of it
034|one thing is called by several words|keep to one word
035|a section of an outline without matter|delete it, or say what it is about
036|the text tells of a change, not of how it is|describe the present state
037|the standard library does this|call the library's function
038|the dependency has a standard counterpart|use the standard one
039|the function only calls another|call that one directly
040|the abstraction has one implementation|use the implementation
041|the text is mechanically even|vary length and words
042|the comment repeats the code|delete it, or say why
043|the comment runs long|move it to the documentation
044|the page has no title of its own|write a title
045|the formatting is mechanically even|check how the file was made
046|the image holds the prompt that made it|remove the metadata, or label the image
047|the image declares that a model made it|label the image where it is shown
048|the image names a generator|label the image where it is shown
049|the image's spectrum has a ridge of upsampling|check how the image was made
050|a comment says that the code stands in for something|write the real thing
051|a comment announces demo code|remove the demo
052|text is filled with a gradient|use one colour
053|a gradient from purple to blue|use the colours of the design
054|a hex value of the stock palette|use the design's variable
055|a violet accent of the stock palette|use the design's accent
056|a stock theme in violet|choose the theme's colours
057|a glyph separates words|use a list or plain punctuation
"""
MESSAGES: dict[str, tuple[str, str]] = {f"PL{number}": (message, fix) for number, message, fix in (line.split("|") for line in _RAW.strip().split("\n"))}
