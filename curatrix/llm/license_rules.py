"""Signatures of licenses, in order of priority: of two detections one inside the other, the earlier rule's stays.

A line is: label | weight | required words | pattern. Patterns are matched against a text's words, in lower case and with
single spaces between them ("GPL-3.0+" is "gpl 3 0"); LIC stands for license or licence, V for an optional "version" and
LATER for "or any later version" and the like. A rule is only tried on texts that have all its required words, of words with
a stroke between them any. Weight: how surely such words mean that the text is under the license or reproduces it.
"""

from __future__ import annotations

#: Label, and the words that stand for it wherever they stand one after another.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

_MACROS = {"LIC": "licen[sc]e", "LATER": "(?:or (?:at your option )?(?:any )?(?:later|newer|higher)(?: version)?|or later)", "V": "(?:version |ver |v ?)?", "UNDER": "(?:under|with|by|to) (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?"}

#: Sentences of licenses and of their notices.
TEXTS = """
agpl-3.0-or-later | .98 | affero later/newer | redistribute it and or modify it under the terms of the gnu affero general public LIC as published by the free software foundation either version 3(?: of the LIC)? or at your option any later version
lgpl-3.0-or-later | .98 | lesser later | redistribute it and or modify it under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3(?: of the LIC)? or at your option any later version
lgpl-2.1-or-later | .98 | lesser later | redistribute it and or modify it under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1(?: of the LIC)? or at your option any later version
lgpl-2.0-or-later | .98 | library later | redistribute it and or modify it under the terms of the gnu library general public LIC as published by the free software foundation either version 2(?: of the LIC)? or at your option any later version
gpl-3.0-or-later | .98 | gnu later | redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 3(?: of the LIC)? or at your option any later version
gpl-2.0-or-later | .98 | gnu later | redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 2(?: of the LIC)? or at your option any later version
gpl-2.0-only | .98 | gnu foundation | redistribute it and or modify it under the terms of the gnu general public LIC version 2(?: only)? as published by the free software foundation
gpl-3.0-only | .98 | gnu foundation | redistribute it and or modify it under the terms of the gnu general public LIC version 3(?: only)? as published by the free software foundation
gfdl-1.3 | .98 | documentation distribute | copy distribute and or modify this document under the terms of the gnu free documentation LIC version 1 3
gfdl-1.2 | .98 | documentation distribute | copy distribute and or modify this document under the terms of the gnu free documentation LIC version 1 2
gfdl-1.1 | .98 | documentation distribute | copy distribute and or modify this document under the terms of the gnu free documentation LIC version 1 1
gpl | .9 | gnu copyleft | the gnu general public LIC is a free copyleft LIC for software and other kinds of works
gpl | .9 | gnu intended | the gnu general public LIC is intended to guarantee your freedom to share and change
gpl | .8 | gnu received | you should have received a copy of the gnu general public LIC along with this (?:program|package|software|library)
lgpl | .8 | lesser received | you should have received a copy of the gnu lesser general public LIC along with this (?:program|package|software|library)
agpl | .8 | affero received | you should have received a copy of the gnu affero general public LIC along with this (?:program|package|software|library)
apache-2.0 | .98 | apache compliance | licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance with the LIC
apache-2.0 | .9 | compliance obtain | you may not use this file except in compliance with the LIC you may obtain a copy of the LIC at
apache-2.0 | .85 | contributor irrevocable | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LIC
apache-2.0 | .8 | unless agreed | unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis
apache-1.1 | .9 | apache developed | this product includes software developed by the apache software foundation
mit-0 | .9 | permission obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | .98 | permission obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | .8 | permission obtaining | permission is hereby granted free of charge to any person obtaining a copy
mit | .6 | copyright substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
x11 | .9 | consortium advertising | except as contained in this notice the name of the x consortium shall not be used in advertising
curl | .9 | permission merchantability | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc | .95 | permission fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | .9 | permission fee | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
ntp | .9 | permission fee | permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted
bsd-4-clause | .9 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | .9 | neither contributors | neither the name of (?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd | .85 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | .8 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | .7 | redistribution permitted | redistribution and use in source and binary forms with or without modification are permitted
mpl-2.0 | .98 | mozilla form | this source code form is subject to the terms of the mozilla public LIC V2 0
mpl-1.1 | .95 | mozilla subject | the contents of this file are subject to the mozilla public LIC version 1 1
mpl-1.0 | .95 | mozilla subject | the contents of this file are subject to the mozilla public LIC version 1 0
epl-2.0 | .95 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:v |version )?2 0
epl-1.0 | .95 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:v |version )?1 0
cddl-1.0 | .95 | development distribution | the contents of this file are subject to the terms of the common development and distribution LIC
boost-1.0 | .95 | permission accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this LIC
zlib | .95 | misrepresented origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | .7 | altered plainly | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | .98 | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | .95 | fuck want | you just do what the fuck you want to
beerware | .9 | beer worth | if we meet some day and you think this stuff is worth it you can buy me a beer
cc0-1.0 | .95 | waives affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1.0 | .9 | waived rights | has waived all copyright and related or neighbo(?:u)?ring rights
cc0-1.0 | .9 | dedicated domain | (?:has |have )?dedicated (?:the|this) (?:work|software|dataset|data) to the public domain by waiving
ofl-1.1 | .95 | font sil | this font software is licensed under the sil open font LIC version 1 1
psf-2.0 | .9 | python psf | this LIC agreement is between the python software foundation psf and the individual or organization
artistic-1.0 | .9 | intent package | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | .9 | everyone package | everyone is permitted to copy and distribute verbatim copies of this LIC document but changing it is not allowed preamble this LIC establishes the terms under which a given free software package may be copied
perl | .9 | perl itself | (?:this )?(?:library|module|program|software) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl(?: 5)?(?: itself)?
ruby | .9 | ruby terms | you (?:can|may) redistribute it and or modify it under (?:either )?the terms of the (?:ruby LIC|2 clause bsdl)
openssl | .9 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ms-pl | .9 | accept software | if you use the software you accept this LIC if you do not accept the LIC do not use the software
sspl-1.0 | .9 | service program | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl-1.1 | .9 | licensor production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
commons-clause | .9 | sell grant | the grant of rights under the LIC will not include and the LIC does not grant to you the right to sell the software
elastic-2.0 | .9 | managed service | you may not provide the software to third parties as a hosted or managed service
json | .9 | evil good | the software shall be used for good not evil
odbl-1.0 | .9 | database open | this (?:[^ ]+ ){1,4}is made available under the open database LIC
pddl | .9 | domain dedication | this (?:[^ ]+ ){1,4}is made available under the public domain dedication and LIC
odc-by-1.0 | .9 | attribution data | this (?:[^ ]+ ){1,4}is made available under the open data commons attribution LIC
vim | .9 | vim charityware | vim is charityware you can use and copy it as much as you like
"""

#: Identifiers in the form that source files carry.
IDENTIFIERS = """
gpl-2.0-or-later | .95 | spdx gpl later | spdx LIC identifier gpl 2 0 or later
gpl-3.0-or-later | .95 | spdx gpl later | spdx LIC identifier gpl 3 0 or later
gpl-2.0-only | .95 | spdx gpl | spdx LIC identifier gpl 2 0(?: only)?
gpl-3.0-only | .95 | spdx gpl | spdx LIC identifier gpl 3 0(?: only)?
lgpl-2.1-or-later | .95 | spdx lgpl later | spdx LIC identifier lgpl 2 1 or later
lgpl-3.0-or-later | .95 | spdx lgpl later | spdx LIC identifier lgpl 3 0 or later
lgpl-2.1-only | .95 | spdx lgpl | spdx LIC identifier lgpl 2 1(?: only)?
lgpl-3.0-only | .95 | spdx lgpl | spdx LIC identifier lgpl 3 0(?: only)?
agpl-3.0-or-later | .95 | spdx agpl later | spdx LIC identifier agpl 3 0 or later
agpl-3.0-only | .95 | spdx agpl | spdx LIC identifier agpl 3 0(?: only)?
gfdl-1.3 | .95 | spdx gfdl | spdx LIC identifier gfdl 1 3(?: only| or later)?
apache-2.0 | .95 | spdx apache | spdx LIC identifier apache 2 0
apache-1.1 | .95 | spdx apache | spdx LIC identifier apache 1 1
mit-0 | .95 | spdx mit | spdx LIC identifier mit 0
mit | .95 | spdx mit | spdx LIC identifier mit
isc | .95 | spdx isc | spdx LIC identifier isc
0bsd | .95 | spdx 0bsd | spdx LIC identifier 0bsd
bsd-2-clause | .95 | spdx bsd | spdx LIC identifier bsd 2 clause
bsd-3-clause | .95 | spdx bsd | spdx LIC identifier bsd 3 clause
bsd-4-clause | .95 | spdx bsd | spdx LIC identifier bsd 4 clause
mpl-2.0 | .95 | spdx mpl | spdx LIC identifier mpl 2 0
mpl-1.1 | .95 | spdx mpl | spdx LIC identifier mpl 1 1
epl-2.0 | .95 | spdx epl | spdx LIC identifier epl 2 0
epl-1.0 | .95 | spdx epl | spdx LIC identifier epl 1 0
eupl-1.2 | .95 | spdx eupl | spdx LIC identifier eupl 1 2
cddl-1.0 | .95 | spdx cddl | spdx LIC identifier cddl 1 0
boost-1.0 | .95 | spdx bsl | spdx LIC identifier bsl 1 0
busl-1.1 | .95 | spdx busl | spdx LIC identifier busl 1 1
zlib | .95 | spdx zlib | spdx LIC identifier zlib
unlicense | .95 | spdx unlicense | spdx LIC identifier unlicense
wtfpl | .95 | spdx wtfpl | spdx LIC identifier wtfpl
ofl-1.1 | .95 | spdx ofl | spdx LIC identifier ofl 1 1
psf-2.0 | .95 | spdx psf/python | spdx LIC identifier (?:psf|python) 2 0
artistic-2.0 | .95 | spdx artistic | spdx LIC identifier artistic 2 0
ms-pl | .95 | spdx ms | spdx LIC identifier ms pl
cc0-1.0 | .95 | spdx cc0 | spdx LIC identifier cc0 1 0
cc-by-nc-nd-4.0 | .95 | spdx cc nd | spdx LIC identifier cc by nc nd 4 0
cc-by-nc-sa-4.0 | .95 | spdx cc nc sa | spdx LIC identifier cc by nc sa 4 0
cc-by-nc-4.0 | .95 | spdx cc nc | spdx LIC identifier cc by nc 4 0
cc-by-nd-4.0 | .95 | spdx cc nd | spdx LIC identifier cc by nd 4 0
cc-by-sa-4.0 | .95 | spdx cc sa | spdx LIC identifier cc by sa 4 0
cc-by-4.0 | .95 | spdx cc | spdx LIC identifier cc by 4 0
"""

#: Names and short forms: those with a version and terms before those without.
NAMES = """
gpl-3.0-or-later | .85 | gnu later/newer/higher | gnu general public LIC V3(?: 0)? LATER
gpl-2.0-or-later | .85 | gnu later/newer/higher | gnu general public LIC V2(?: 0)? LATER
gpl-1.0-or-later | .85 | gnu later/newer/higher | gnu general public LIC V1(?: 0)? LATER
gpl-3.0-only | .85 | gnu only | gnu general public LIC V3(?: 0)? only
gpl-2.0-only | .85 | gnu only | gnu general public LIC V2(?: 0)? only
gpl-3.0 | .85 | gnu 3 | gnu general public LIC V3(?: 0)?
gpl-2.0 | .85 | gnu 2 | gnu general public LIC V2(?: 0)?
gpl-1.0 | .85 | gnu 1 | gnu general public LIC V1(?: 0)?
gpl-3.0 | .8 | gpl 3 | (?:gnu )?gpl V3(?: 0)?
gpl-2.0 | .8 | gpl 2 | (?:gnu )?gpl V2(?: 0)?
gpl-3.0 | .8 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | .8 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | .7 | gpl3 | (?:gnu )?gpl3
gpl-2.0 | .7 | gpl2 | (?:gnu )?gpl2
lgpl-3.0-or-later | .85 | gnu lesser later | gnu lesser general public LIC V3(?: 0)? LATER
lgpl-2.1-or-later | .85 | gnu lesser later | gnu lesser general public LIC V2 1 LATER
lgpl-3.0 | .85 | gnu lesser 3 | gnu lesser general public LIC V3(?: 0)?
lgpl-2.1 | .85 | gnu lesser 2 | gnu lesser general public LIC V2 1
lgpl-2.0 | .85 | gnu library 2 | gnu library general public LIC V2(?: 0)?
lgpl-3.0 | .8 | lgpl 3 | (?:gnu )?lgpl V3(?: 0)?
lgpl-2.1 | .8 | lgpl 2 | (?:gnu )?lgpl V2 1
lgpl-3.0 | .8 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | .8 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
agpl-3.0-or-later | .85 | affero later | (?:gnu )?affero general public LIC V3(?: 0)? LATER
agpl-3.0 | .85 | affero 3 | (?:gnu )?affero general public LIC V3(?: 0)?
agpl-1.0 | .85 | affero 1 | affero general public LIC V1(?: 0)?
agpl-3.0 | .8 | agpl 3 | (?:gnu )?agpl V3(?: 0)?
agpl-3.0 | .8 | agplv3 | (?:gnu )?agplv3
gfdl-1.3 | .85 | documentation 1 3 | gnu free documentation LIC V1 3
gfdl-1.2 | .85 | documentation 1 2 | gnu free documentation LIC V1 2
gfdl-1.1 | .85 | documentation 1 | gnu free documentation LIC V1 1
classpath-exception-2.0 | .85 | classpath exception | (?:gpl|general public LIC)(?: [^ ]+){0,4} with (?:the )?classpath exception
gcc-exception-3.1 | .85 | gcc runtime exception | gcc runtime library exception(?: V3 1)?
apache-2.0 | .9 | apache 2 | UNDERapache LIC V2(?: 0)?
apache-2.0 | .85 | apache 2 | apache LIC V2(?: 0)?
apache-2.0 | .8 | apache 2 | apache software LIC V2(?: 0)?
apache-1.1 | .85 | apache 1 | apache (?:software )?LIC V1 1
apache-1.0 | .85 | apache 1 | apache (?:software )?LIC V1 0
apache-2.0 | .7 | apache 2 | apache V2 0
apache-2.0 | .7 | asl 2 | asl V2 0
mit | .9 | mit | (?:licensed|released|distributed|available|published|covered) UNDERmit LIC
mit | .9 | mit | (?:licensed|released|distributed|available|published|covered) UNDER(?:mit x11|x11 mit|expat mit|mit expat) LIC
mit-0 | .85 | mit attribution | mit no attribution(?: LIC)?
mit | .8 | mit expat/x11 | (?:mit expat|expat mit|mit x11) LIC
mit | .8 | mit licensed | mit licensed
mit | .75 | mit lizenz | unter der mit lizenz
mit | .75 | mit licence | (?:sous|selon la) (?:la )?licence mit
mit | .75 | mit licencia | (?:bajo|con) (?:la )?licencia mit
mit | .75 | mit licenza | (?:sotto|con) licenza mit
expat | .75 | expat license/licence | expat LIC
x11 | .75 | x11 license/licence | x11 LIC
isc | .8 | isc license/licence | UNDERisc LIC
isc | .7 | isc license/licence | isc LIC
0bsd | .8 | bsd zero/0 | (?:zero|0) clause bsd(?: LIC)?
bsd-1-clause | .8 | bsd 1/one | (?:1|one) clause bsd(?: LIC)?
bsd-2-clause | .8 | bsd 2/two | (?:2|two) clause bsd(?: LIC)?
bsd-3-clause | .8 | bsd 3/three | (?:3|three) clause bsd(?: LIC)?
bsd-4-clause | .8 | bsd 4/four | (?:4|four) clause bsd(?: LIC)?
bsd-2-clause | .8 | bsd simplified | simplified bsd LIC
bsd-2-clause | .8 | freebsd license/licence | freebsd LIC
bsd-3-clause | .8 | bsd new/revised/modified | (?:new|revised|modified) bsd LIC
bsd-4-clause | .8 | bsd original | (?:original|old) bsd LIC
bsd-2-clause | .75 | bsd 2 | bsd 2 clause(?: LIC)?
bsd-3-clause | .75 | bsd 3 | bsd 3 clause(?: LIC)?
bsd-4-clause | .75 | bsd 4 | bsd 4 clause(?: LIC)?
bsd-3-clause-clear | .8 | bsd clear | clear bsd LIC
mpl-2.0 | .85 | mozilla 2 | mozilla public LIC V2(?: 0)?
mpl-1.1 | .85 | mozilla 1 | mozilla public LIC V1 1
mpl-1.0 | .85 | mozilla 1 | mozilla public LIC V1 0
mpl-2.0 | .8 | mpl 2 | mpl V2 0
mpl-1.1 | .8 | mpl 1 | mpl V1 1
npl-1.1 | .8 | netscape | netscape public LIC(?: V1 [01])?
epl-2.0 | .85 | eclipse 2 | eclipse public LIC V2(?: 0)?
epl-1.0 | .85 | eclipse 1 | eclipse public LIC V1(?: 0)?
edl-1.0 | .85 | eclipse distribution | eclipse distribution LIC(?: V1 0)?
cpl-1.0 | .8 | common public | common public LIC(?: V1 0)?
ipl-1.0 | .8 | ibm public | ibm public LIC(?: V1 0)?
cddl-1.1 | .85 | development distribution 1 | common development and distribution LIC V1 1
cddl-1.0 | .85 | development distribution | common development and distribution LIC(?: V1 0)?
cddl-1.0 | .75 | cddl 1 | cddl V1 0
eupl-1.2 | .85 | european 1 2 | european union public LIC V1 2
eupl-1.1 | .85 | european 1 | european union public LIC V1 1
eupl-1.2 | .75 | eupl 1 2 | eupl V1 2
eupl-1.1 | .75 | eupl 1 | eupl V1 1
cecill-2.1 | .8 | cecill 2 1 | cecill(?: free software LIC)?(?: agreement)? V2 1
cecill-c | .8 | cecill c | cecill c(?: LIC)?
cecill-b | .8 | cecill b | cecill b(?: LIC)?
artistic-2.0 | .85 | artistic 2 | (?:perl )?artistic LIC V2(?: 0)?
artistic-1.0 | .85 | artistic 1 | (?:perl )?artistic LIC V1(?: 0)?
afl-3.0 | .85 | academic 3 | academic free LIC V3 0
afl-2.1 | .85 | academic 2 1 | academic free LIC V2 1
osl-3.0 | .85 | open 3 software | open software LIC V3 0
osl-2.1 | .85 | open 2 software | open software LIC V2 1
ms-pl | .85 | microsoft public | microsoft public LIC
ms-rl | .85 | microsoft reciprocal | microsoft reciprocal LIC
ms-lpl | .8 | microsoft limited | microsoft limited public LIC
boost-1.0 | .85 | boost 1 | boost software LIC V1(?: 0)?
boost-1.0 | .75 | boost software | boost software LIC
zlib-acknowledgement | .75 | zlib libpng | zlib libpng LIC with acknowledgement
zlib | .75 | zlib license/licence | (?:zlib libpng|zlib) LIC
libpng-2.0 | .75 | libpng license/licence | (?:png reference library|libpng) LIC(?: V2)?
unlicense | .75 | unlicense | (?:the )?unlicense
wtfpl | .8 | fuck public | do what the fuck you want to public LIC
wtfpl | .75 | wtfpl | wtfpl
ofl-1.1 | .85 | sil font 1 | sil open font LIC V1 1
ofl-1.0 | .85 | sil font 1 | sil open font LIC V1 0
ofl-1.1 | .75 | sil font | sil open font LIC
psf-2.0 | .8 | python software foundation | python software foundation LIC(?: V2)?
python-2.0 | .75 | python license/licence | python LIC(?: V2(?: 0)?)?
php-3.01 | .8 | php 3 01 | php LIC V3 01
php-3.0 | .8 | php 3 | php LIC V3(?: 0)?
qpl-1.0 | .8 | q public | q public LIC(?: V1 0)?
ruby | .7 | ruby license/licence | ruby LIC
sleepycat | .8 | sleepycat | sleepycat LIC
openldap-2.8 | .8 | openldap | openldap public LIC(?: V2 8)?
postgresql | .8 | postgresql license/licence | postgresql LIC
lppl-1.3c | .8 | latex 1 3c | latex project public LIC V1 3c
lppl-1.3 | .8 | latex 1 3 | latex project public LIC V1 3
lppl | .75 | latex project | latex project public LIC
naist-2003 | .75 | naist | naist LIC
ncsa | .8 | ncsa | (?:university of illinois )?(?:ncsa )?open source LIC ncsa|(?:university of illinois )?ncsa open source LIC
upl-1.0 | .8 | universal permissive | universal permissive LIC(?: V1 0)?
blueoak-1.0.0 | .85 | blue oak | blue oak model LIC(?: V?1 0 0)?
mulan-2.0 | .85 | mulan 2 | mulan (?:psl|permissive software LIC) V2
mulan-1.0 | .85 | mulan 1 | mulan (?:psl|permissive software LIC) V1
ecl-2.0 | .8 | educational 2 | educational community LIC V2 0
watcom-1.0 | .8 | watcom sybase | sybase open watcom public LIC(?: V1 0)?
apsl-2.0 | .8 | apple 2 | apple public source LIC V2 0
w3c | .8 | w3c software | w3c software (?:notice and LIC|and document (?:notice and )?LIC|LIC)
unicode-dfs | .8 | unicode license/licence | unicode(?: data files and software)? LIC(?: V3)?
icu | .75 | icu license/licence | icu LIC
hpnd | .75 | historical permission | historical permission notice and disclaimer
sspl-1.0 | .85 | server side public | server side public LIC(?: V1(?: 0)?)?
sspl-1.0 | .75 | sspl | sspl(?: V1(?: 0)?)?
busl-1.1 | .85 | business source | business source LIC(?: V1 [01])?
elastic-2.0 | .85 | elastic 2 | elastic LIC V2(?: 0)?
elastic-1.0 | .75 | elastic license/licence | elastic LIC
confluent-1.0 | .85 | confluent community | confluent community LIC(?: V1 0)?
commons-clause | .8 | commons clause | commons clause(?: LIC)?(?: condition)?(?: V1 0)?
polyform-noncommercial-1.0.0 | .85 | polyform noncommercial | polyform noncommercial LIC(?: V?1 0 0)?
polyform-small-business-1.0.0 | .85 | polyform business | polyform small business LIC(?: V?1 0 0)?
polyform-shield-1.0.0 | .85 | polyform shield | polyform shield LIC(?: V?1 0 0)?
fair-source | .75 | fair source license/licence | (?:functional source|fair source) LIC
parity-7.0.0 | .75 | parity public | parity public LIC
prosperity-3.0.0 | .75 | prosperity public | prosperity public LIC
cc-by-nc-nd-4.0 | .9 | cc nc nd 4 | cc by nc nd V4 0
cc-by-nc-nd-3.0 | .9 | cc nc nd 3 | cc by nc nd V3 0
cc-by-nc-nd-2.5 | .9 | cc nc nd 2 5 | cc by nc nd V2 5
cc-by-nc-nd-2.0 | .9 | cc nc nd 2 | cc by nc nd V2 0
cc-by-nc-nd-1.0 | .9 | cc nc nd 1 | cc by nc nd V1 0
cc-by-nc-sa-4.0 | .9 | cc nc sa 4 | cc by nc sa V4 0
cc-by-nc-sa-3.0 | .9 | cc nc sa 3 | cc by nc sa V3 0
cc-by-nc-sa-2.5 | .9 | cc nc sa 2 5 | cc by nc sa V2 5
cc-by-nc-sa-2.0 | .9 | cc nc sa 2 | cc by nc sa V2 0
cc-by-nc-sa-1.0 | .9 | cc nc sa 1 | cc by nc sa V1 0
cc-by-nc-4.0 | .9 | cc nc 4 | cc by nc V4 0
cc-by-nc-3.0 | .9 | cc nc 3 | cc by nc V3 0
cc-by-nc-2.5 | .9 | cc nc 2 5 | cc by nc V2 5
cc-by-nc-2.0 | .9 | cc nc 2 | cc by nc V2 0
cc-by-nc-1.0 | .9 | cc nc 1 | cc by nc V1 0
cc-by-nd-4.0 | .9 | cc nd 4 | cc by nd V4 0
cc-by-nd-3.0 | .9 | cc nd 3 | cc by nd V3 0
cc-by-nd-2.5 | .9 | cc nd 2 5 | cc by nd V2 5
cc-by-nd-2.0 | .9 | cc nd 2 | cc by nd V2 0
cc-by-sa-4.0 | .9 | cc sa 4 | cc by sa V4 0
cc-by-sa-3.0 | .9 | cc sa 3 | cc by sa V3 0
cc-by-sa-2.5 | .9 | cc sa 2 5 | cc by sa V2 5
cc-by-sa-2.0 | .9 | cc sa 2 | cc by sa V2 0
cc-by-sa-1.0 | .9 | cc sa 1 | cc by sa V1 0
cc-by-4.0 | .9 | cc 4 | cc by V4 0
cc-by-3.0 | .9 | cc 3 | cc by V3 0
cc-by-2.5 | .9 | cc 2 5 | cc by V2 5
cc-by-2.0 | .9 | cc 2 | cc by V2 0
cc-by-1.0 | .9 | cc 1 | cc by V1 0
cc-by-nc-nd | .8 | cc nc nd | cc by nc nd
cc-by-nc-sa | .8 | cc nc sa | cc by nc sa
cc-by-nc | .8 | cc nc | cc by nc
cc-by-nd | .8 | cc nd | cc by nd
cc-by-sa | .8 | cc sa | cc by sa
cc-by-nc-nd | .85 | creative noncommercial/commercial noderivatives/noderivs/derivatives/derivative/derivs | creative commons attribution non ?commercial (?:noderivatives|noderivs|no derivatives|no derivs|no derivative works|no derivative)(?: V[1-4] [05])?(?: international| unported| generic)?
cc-by-nc-sa | .85 | creative noncommercial/commercial sharealike/share | creative commons attribution non ?commercial share ?alike(?: V[1-4] [05])?(?: international| unported| generic)?
cc-by-nc | .85 | creative noncommercial/commercial | creative commons attribution non ?commercial(?: V[1-4] [05])?(?: international| unported| generic)?
cc-by-nd | .85 | creative noderivatives/noderivs/derivatives/derivative/derivs | creative commons attribution (?:noderivatives|noderivs|no derivatives|no derivs|no derivative works|no derivative)(?: V[1-4] [05])?(?: international| unported| generic)?
cc-by-sa-4.0 | .9 | creative sharealike/share 4 | creative commons attribution share ?alike V4 0(?: international)?
cc-by-sa-3.0 | .9 | creative sharealike/share 3 | creative commons attribution share ?alike V3 0(?: unported)?
cc-by-sa | .85 | creative sharealike/share | creative commons attribution share ?alike(?: V[12] [05])?(?: generic)?
cc-by-4.0 | .9 | creative attribution 4 | creative commons attribution V4 0(?: international)?(?: LIC)?
cc-by-3.0 | .9 | creative attribution 3 | creative commons attribution V3 0(?: unported)?(?: LIC)?
cc-by-2.0 | .9 | creative attribution 2 | creative commons attribution V2 [05](?: generic)?(?: LIC)?
cc-by | .8 | creative attribution | creative commons attribution(?: LIC)?
cc0-1.0 | .9 | cc0 1 | cc0 V1 0(?: universal)?
cc0-1.0 | .85 | creative zero/cc0 | creative commons (?:cc0|zero)(?: V1 0)?(?: universal)?
cc0-1.0 | .75 | cc0 | cc0
cc-pdm | .8 | domain mark | public domain mark(?: V?1 0)?
cc-by-nc-nd | .85 | creativecommons nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | .85 | creativecommons nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | .85 | creativecommons nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | .85 | creativecommons nd | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | .85 | creativecommons sa | creativecommons org licenses by sa [1-4] [05]
cc-by | .85 | creativecommons by | creativecommons org licenses by [1-4] [05]
cc0-1.0 | .85 | creativecommons zero | creativecommons org publicdomain zero 1 0
odbl-1.0 | .85 | database odbl/open | (?:open data commons )?open database LIC(?: odbl)?(?: V1 0)?
odbl-1.0 | .75 | odbl | odbl(?: V1 0)?
odc-by-1.0 | .8 | commons attribution data | open data commons attribution LIC(?: V1 0)?
pddl-1.0 | .8 | pddl | pddl(?: V1 0)?
cdla-permissive-2.0 | .85 | cdla/community permissive 2 | (?:community data LIC agreement|cdla) permissive V2 0
cdla-permissive-1.0 | .85 | cdla/community permissive 1 | (?:community data LIC agreement|cdla) permissive V1 0
cdla-sharing-1.0 | .85 | cdla/community sharing | (?:community data LIC agreement|cdla) sharing V1 0
ogl-uk-3.0 | .85 | government 3 | open government LIC V3 0
ogl-uk-2.0 | .85 | government 2 | open government LIC V2 0
ogl | .75 | open government | open government LIC
etalab-2.0 | .8 | etalab/licence ouverte | (?:etalab )?licence ouverte(?: V2 0)?
dl-de-by-2.0 | .8 | datenlizenz | datenlizenz deutschland namensnennung(?: V?2 0)?
free-art-1.3 | .75 | free art | free art LIC(?: V?1 3)?
llama-3 | .85 | llama 3 | llama 3(?: [123])? community LIC(?: agreement)?
llama-2 | .85 | llama 2 | llama 2 community LIC(?: agreement)?
gemma | .75 | gemma terms | gemma terms of use
creativeml-openrail-m | .85 | creativeml | creativeml open ?rail m(?: LIC)?
bigscience-openrail-m | .85 | bigscience | bigscience (?:bloom )?(?:open ?)?rail(?: m)?(?: LIC)?
openrail | .75 | openrail | openrail(?: m| d)?
"""

#: What stays when none of those above says more.
FAMILIES = """
lgpl | .7 | gnu lesser/library | gnu (?:lesser|library) general public LIC
agpl | .7 | affero | (?:gnu )?affero general public LIC
gfdl | .7 | documentation gnu | gnu free documentation LIC
gpl | .6 | gpl | (?:gnu )?gpl(?: LIC)?
lgpl | .6 | lgpl | (?:gnu )?lgpl(?: LIC)?
agpl | .6 | agpl | (?:gnu )?agpl(?: LIC)?
gpl | .7 | gnu general | gnu general public licence
apache | .6 | apache | apache software LIC
apache | .7 | apache licence | apache licence
mit | .65 | mit licence | mit licence
bsd | .6 | bsd license/licence | bsd LIC
bsd | .6 | bsd style | bsd style LIC
mpl | .65 | mozilla public | mozilla public LIC
epl | .65 | eclipse public | eclipse public LIC
eupl | .65 | european public | european union public LIC
cecill | .65 | cecill | cecill
artistic | .65 | artistic license/licence | artistic LIC
public-domain | .6 | public domain | (?:released|placed|dedicated|is) (?:in|into|to|in to) the public domain
public-domain | .4 | public domain | (?:this (?:work|file|document|text) is )?public domain
creative-commons | .5 | creative commons | creative commons(?: LIC)?
all-rights-reserved | .5 | rights reserved | all rights reserved
all-rights-reserved | .5 | alle rechte vorbehalten | alle rechte vorbehalten
all-rights-reserved | .5 | tous réservés | tous droits réservés
all-rights-reserved | .5 | todos derechos | todos los derechos reservados
proprietary | .6 | proprietary confidential | proprietary and confidential|confidential and proprietary
noncommercial | .4 | noncommercial/commercial | for (?:personal and )?non ?commercial use only
"""


def rules() -> list[tuple[str, float, tuple[frozenset[bytes], ...], bytes]]:
    """Label, weight, the sets of words of which each must be met, and pattern, in order of priority; the base phrases are the last."""
    out = []
    for line in "".join((TEXTS, IDENTIFIERS, NAMES, FAMILIES)).strip().splitlines():
        if not line:
            continue
        label, weight, required, pattern = (x.strip() for x in line.split(" | "))
        for name, meaning in _MACROS.items():
            pattern = pattern.replace(name, meaning)
        needed = (some.split("/") for some in required.split())
        out.append((label, float(weight), tuple(frozenset(w.encode() for x in some for w in ((x, f"v{x}") if x.isdigit() else (x,))) for some in needed), pattern.encode()))
    return out + [(label, 0.65, tuple(frozenset([w.encode()]) for w in phrase.split()), phrase.encode()) for label, phrase in BASE]
