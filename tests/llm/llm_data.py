import random

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "la", "mi")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    words = [r.choice(WORDS) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(words))


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        at, what = r.randrange(len(words)), r.randrange(3)
        if what == 0:
            words[at] = "changed"
        elif what == 1:
            words.insert(at, "added")
        else:
            del words[at]
    return " ".join(words)


def texts_with_notices():
    filler = "lorem ipsum dolor sit amet " * 30
    return [
        (101, filler + "Released under the MIT License."),
        (102, "Licensed under CC BY-NC 4.0.\n" + filler),
        (103, filler + "This work is licensed under the GNU General Public License, version 3." + filler),
        (104, "Licensed under the Apache License, Version 2.0."),
        (105, filler + "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and its documentation files (the 'Software'), to deal in the Software without any restriction" + filler),
        (106, filler + "The license of the under version released mit"),
        (107, "cc cc by by cc by all rights all rights reserved"),
        (108, "ALL RIGHTS RESERVED " * 50),
        (109, "General Public Licence general public license"),
    ]
