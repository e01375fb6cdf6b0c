"""Licence notices as data: label, text and mandatory key phrase, word by word in lower case.

Fixed values: the wording of public licences and of the notices that they ask for. A label may have several
texts; a caller may pass others.
"""

from __future__ import annotations

#: Phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_GNU = (
    "is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either "
    "version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful but "
    "without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details "
    "you should have received a copy of the {name} along with this program"
)
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
    "in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "{n1} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "{n2} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution"
)

NOTICES: tuple[tuple[str, str, str], ...] = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "this program " + _GNU.format(name="gnu general public license", version="3"), "either version 3 of the license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "this program " + _GNU.format(name="gnu general public license", version="2"), "either version 2 of the license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("lgpl", "this library " + _GNU.format(name="gnu lesser general public license", version="2 1"), "gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("agpl", "this program " + _GNU.format(name="gnu affero general public license", version="3"), "gnu affero general public license as published by the free software foundation"),
    ("mit-notice", "released under the mit license", "mit license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
        "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
        "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY,
        "permission is hereby granted free of charge",
    ),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-2-clause", _BSD.format(n1="1", n2="2"), "redistributions in binary form must reproduce the above copyright notice"),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at",
        "mozilla public license",
    ),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software",
    ),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
)
