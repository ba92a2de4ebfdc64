"""Hand-written signatures of licenses, in order: an earlier rule outranks a later one.

A line is: label, strength in tenths, words of which every match holds one (apart by /), and a pattern over lower-cased
words with one space between them. `*` as a word stands for any word; quantifiers are bounded, so no
match is longer than MOST_WORDS words. BASE rules come first and always stay.
"""

from __future__ import annotations

from typing import NamedTuple

#: No pattern matches more words.
MOST_WORDS = 48

BASE = """
cc-by 4 cc cc by
gpl 5 general general public license
reserved 3 reserved all rights reserved
"""

RULES = """
mit 10 hereby permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 9 furnish/furnished to permit persons to whom the software is furnish(ed)? to do so|persons to whom the software is furnish(ed)? to
isc 10 hereby permission to use copy modify and( or)? distribute this software( and its documentation)? for any purpose with or without fee is hereby granted
hpnd 9 hereby permission to use copy modify and distribute this software and its documentation for any purpose( and)? without fee is hereby granted
bsd 10 redistribution redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause 9 acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause 9 endorse neither the names?( of)?( *){1,8} may be used to endorse or promote products derived from this software
bsd-2-clause 7 reproduce redistributions in binary form must reproduce the above copyright notice
bsd-2-clause 7 retain redistributions of source code must retain the above copyright notice
zlib 10 misrepresented the origin of this software must not be misrepresented
zlib 8 altered altered source versions must be plainly marked as such
zlib 8 warranty this software is provided as is without any express or implied warranty
libpng 8 png the png reference library is supplied as is
apache-2.0 10 compliance you may not use this file except in compliance with the license
apache-2.0 10 apache licensed under the apache license version 2 0 the license
apache-2.0 9 apache obtain a copy of the license at https? www apache org licenses license 2 0
apache-1.1 9 apache this product includes software developed by the apache software foundation
gpl-3.0-or-later 10 either either version 3 of the license or( at your option)? any later version
gpl-2.0-or-later 10 either either version 2 of the license or( at your option)? any later version
lgpl-2.1-or-later 10 either either version 2 1 of the license or( at your option)? any later version
gpl 9 redistribute you can redistribute it and or modify it under the terms of the gnu general public license
lgpl 9 redistribute you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
agpl 9 redistribute you can redistribute it and or modify it under the terms of the gnu affero general public license
gfdl 9 copy permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gpl 8 merchantability without even the implied warranty of merchantability or fitness for a particular purpose
mpl-2.0 10 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 10 mozilla the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 10 mozilla the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 9 netscape the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 9 cddl the contents of this file are subject to the terms of the( *){0,4} cddl
epl-2.0 10 eclipse made available under the terms of the eclipse public license( v)? 2 0
epl-1.0 10 eclipse made available under the terms of the eclipse public license( v)? 1 0
boost-1.0 10 boost distributed under the boost software license version 1 0
boost-1.0 9 boost boost software license version 1 0 august 17th 2003
unlicense 10 unencumbered this is free and unencumbered software released into the public domain
wtfpl 10 public do what the (fuck|f ck|hell) you want to public license
beerware 9 beer if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0-1.0 10 dedicated has dedicated the work to the public domain by waiving all of his or her rights
openssl 9 openssl this product includes software developed by the openssl project for use in the openssl toolkit
ssleay 9 cryptographic this product includes cryptographic software written by eric young
ofl-1.1 10 sil this font software is licensed under the sil open font license version 1 1
artistic-1.0 8 artistic under the same terms as perl itself( *){0,6} artistic license
perl 8 perl (under )?the same terms as perl( 5)? itself
psf-2.0 8 psf psf is making python available to licensee on an as is basis
python-2.0 8 python psf license agreement for python
php-3.01 8 php this source file is subject to version 3 01 of the php license
php-3.0 8 php this source file is subject to version 3 0 of the php license
ncsa 8 illinois developed by( *){1,8} university of illinois
curl 8 curl copyright c( *){1,6} daniel stenberg( *){0,6} curl
json 9 evil the software shall be used for good not evil
x11 8 consortium except as contained in this notice the name of the x consortium shall not be used
postgresql 8 postgresql portions copyright c( *){1,6} postgresql global development group
unicode 8 unicode unicode license agreement data files and software
ijg 8 jpeg this software is based in part on the work of the independent jpeg group
freetype 8 freetype portions of this software are copyright( *){1,6} the freetype project
tcl 7 tcl the authors hereby grant permission to use copy modify distribute and license this software( *){0,8} tcl
vim 7 vim vim is charityware
sleepycat 7 sleepycat redistributions in any form must be accompanied by information on how to obtain complete source code( *){0,20} sleepycat
public-domain 8 public (is|are|was|been|hereby) (placed|released|dedicated)( *){0,2} (in|into|to) the public domain
public-domain 7 public this (file|work|code|software|program|document) is in the public domain
proprietary 8 proprietary (this (file|document|software) (is|contains) )?(confidential and proprietary|proprietary and confidential)( information)?
proprietary 8 unauthorized unauthorized (copying|reproduction|distribution|use)( or distribution)? of this (file|document|software|work)( via any medium)? is strictly prohibited
proprietary 7 reproduced no part of this (publication|work|book|document|site) may be reproduced
proprietary 6 permission (may not be (reproduced|copied|distributed|republished)( *){0,4} )?without( the)?( prior| express){1,2} written permission
non-commercial 6 commercial (for )?(personal|private|educational|academic|research)( and| or)?( personal| private| educational| academic| research)? non commercial use only
non-commercial 5 commercial not for commercial (use|purposes|redistribution)
non-commercial 5 commercial/noncommercial free for non ?commercial (use|purposes)|noncommercial use only
apache-2.0 9 apache apache license (version |v )?2 0
apache-2.0 9 apache apache (license )?v?2 0( license)?
apache-2.0 8 apache apache license v?2|apache 2 license
apache-2.0 8 asl asl( version| v)? 2 0
apache-1.1 8 apache apache( software)? license (version |v )?1 1
apache-1.0 8 apache apache( software)? license (version |v )?1 0
agpl-3.0 9 affero gnu affero general public license( version| v)? 3( 0)?
agpl-3.0 9 agpl agpl( version| v)? 3( 0)?( only| or later)?
agpl-3.0 9 agplv3 (gnu )?agplv3
agpl-1.0 8 affero affero general public license( version| v)? 1( 0)?
agpl 7 affero (gnu )?affero general public license
agpl 6 agpl (gnu )?agpl
lgpl-3.0 9 lesser gnu lesser general public license( version| v)? 3( 0)?
lgpl-3.0 9 lgpl lgpl( version| v)? 3( 0)?( only| or later)?
lgpl-3.0 9 lgplv3 (gnu )?lgplv3
lgpl-2.1 9 lesser gnu lesser general public license( version| v)? 2 1
lgpl-2.1 9 lgpl lgpl( version| v)? 2 1( only| or later)?
lgpl-2.1 9 lgplv2 (gnu )?lgplv2( 1)?
lgpl-2.0 9 library gnu library general public license( version| v)? 2( 0)?
lgpl-2.0 8 lgpl lgpl( version| v)? 2( 0)?( only| or later)?
lgpl 7 lesser (gnu )?lesser general public license
lgpl 7 library (gnu )?library general public license
lgpl 6 lgpl (gnu )?lgpl
gpl-3.0 9 gnu gnu general public license( version| v)? 3( 0)?
gpl-3.0 9 gpl (gnu )?gpl( version| v)? 3( 0)?( only| or later)?
gpl-3.0 9 gplv3 (gnu )?gplv3
gpl-2.0 9 gnu gnu general public license( version| v)? 2( 0)?
gpl-2.0 9 gpl (gnu )?gpl( version| v)? 2( 0)?( only| or later)?
gpl-2.0 9 gplv2 (gnu )?gplv2
gpl-1.0 8 gnu gnu general public license( version| v)? 1( 0)?
gpl-1.0 8 gpl (gnu )?gpl( version| v)? 1( 0)?( only| or later)?
gpl-classpath 9 classpath (gpl|general public license)( *){0,4} with( the)? classpath exception
gpl-font 8 font (gpl|general public license)( *){0,4} with( the)? font exception
gpl-linking 8 linking (gpl|general public license)( *){0,6} linking exception
gpl 7 gnu gnu general public license
gpl 6 gnu gnu gpl|gnu public license
gfdl-1.3 9 documentation gnu free documentation license( version| v)? 1 3
gfdl-1.2 9 documentation gnu free documentation license( version| v)? 1 2
gfdl-1.1 9 documentation gnu free documentation license( version| v)? 1 1
gfdl 8 documentation (gnu )?free documentation license
gfdl 6 gfdl (gnu )?gfdl( 1 [0-3])?
cc-by-nc-nd-4.0 9 cc cc by nc nd( v)? 4 0
cc-by-nc-nd-3.0 9 cc cc by nc nd( v)? 3 0
cc-by-nc-nd-2.5 9 cc cc by nc nd( v)? 2 5
cc-by-nc-nd-2.0 9 cc cc by nc nd( v)? 2 0
cc-by-nc-nd 8 cc cc by nc nd
cc-by-nc-sa-4.0 9 cc cc by nc sa( v)? 4 0
cc-by-nc-sa-3.0 9 cc cc by nc sa( v)? 3 0
cc-by-nc-sa-2.5 9 cc cc by nc sa( v)? 2 5
cc-by-nc-sa-2.0 9 cc cc by nc sa( v)? 2 0
cc-by-nc-sa 8 cc cc by nc sa
cc-by-nc-4.0 9 cc cc by nc( v)? 4 0
cc-by-nc-3.0 9 cc cc by nc( v)? 3 0
cc-by-nc-2.5 9 cc cc by nc( v)? 2 5
cc-by-nc-2.0 9 cc cc by nc( v)? 2 0
cc-by-nc 8 cc cc by nc
cc-by-nd-4.0 9 cc cc by nd( v)? 4 0
cc-by-nd-3.0 9 cc cc by nd( v)? 3 0
cc-by-nd-2.5 9 cc cc by nd( v)? 2 5
cc-by-nd-2.0 9 cc cc by nd( v)? 2 0
cc-by-nd 8 cc cc by nd
cc-by-sa-4.0 9 cc cc by sa( v)? 4 0
cc-by-sa-3.0 9 cc cc by sa( v)? 3 0
cc-by-sa-2.5 9 cc cc by sa( v)? 2 5
cc-by-sa-2.0 9 cc cc by sa( v)? 2 0
cc-by-sa 8 cc cc by sa
cc-by-4.0 9 cc cc by( v)? 4 0
cc-by-3.0 9 cc cc by( v)? 3 0
cc-by-2.5 9 cc cc by( v)? 2 5
cc-by-2.0 9 cc cc by( v)? 2 0
cc0-1.0 9 cc0 cc0( v)? 1 0( universal)?
cc0-1.0 8 cc0 (licensed under )?cc0|cc0 license
cc0-1.0 8 zero (creative commons|cc) zero( license)?
cc-pdm-1.0 8 mark (creative commons )?public domain mark( 1 0)?
cc-by-nc-nd-4.0 9 noderivatives/derivatives attribution non ?commercial no ?derivatives 4 0( international)?
cc-by-nc-sa-4.0 9 sharealike attribution non ?commercial sharealike 4 0( international)?
cc-by-nc-sa-4.0 9 alike attribution non ?commercial share alike 4 0( international)?
cc-by-nc-sa-3.0 9 sharealike attribution non ?commercial sharealike 3 0( unported)?
cc-by-nc-4.0 9 noncommercial attribution noncommercial 4 0( international)?
cc-by-nc-3.0 9 noncommercial attribution noncommercial 3 0( unported)?
cc-by-nd-4.0 9 noderivatives attribution noderivatives 4 0( international)?
cc-by-nd-3.0 9 noderivs attribution noderivs 3 0( unported)?
cc-by-sa-4.0 9 sharealike attribution sharealike 4 0( international)?
cc-by-sa-3.0 9 sharealike attribution sharealike 3 0( unported)?
cc-by-sa-2.5 9 sharealike attribution sharealike 2 5( generic)?
cc-by-sa-2.0 9 sharealike attribution sharealike 2 0( generic)?
cc-by-sa-3.0 8 alike attribution share alike 3 0
cc-by-4.0 9 attribution attribution 4 0 international
cc-by-3.0 9 attribution attribution 3 0( unported)?
cc-by-2.5 9 attribution attribution 2 5( generic)?
cc-by-2.0 9 attribution attribution 2 0( generic)?
cc-by 7 attribution creative commons attribution( license)?
cc-link 7 creativecommons (https? )?(www )?creativecommons org licenses by( nc)?( nd| sa)? [1-4] [05]
cc0-1.0 8 creativecommons creativecommons org publicdomain zero 1 0
cc-pdm-1.0 8 creativecommons creativecommons org publicdomain mark 1 0
creative-commons 5 commons creative commons( license[ds]?)?
mpl-2.0 9 mozilla mozilla public license( version| v)? 2 0
mpl-2.0 9 mpl mpl( version| v)? 2 0
mpl-1.1 9 mozilla mozilla public license( version| v)? 1 1
mpl-1.1 9 mpl mpl( version| v)? 1 1
mpl-1.0 9 mozilla mozilla public license( version| v)? 1 0
mpl 7 mozilla mozilla public license
npl-1.0 8 netscape netscape public license( version| v)? 1 0
npl 7 netscape netscape public license
epl-2.0 9 eclipse eclipse public license( version| v)? 2 0
epl-2.0 9 epl epl( version| v)? 2 0
epl-1.0 9 eclipse eclipse public license( version| v)? 1 0
epl-1.0 9 epl epl( version| v)? 1 0
epl 7 eclipse eclipse public license
edl-1.0 8 eclipse eclipse distribution license( version| v)? 1 0
cpl-1.0 8 common common public license( version| v)?( 1 0)?
cpal-1.0 8 common common public attribution license( version| v)?( 1 0)?
ipl-1.0 8 ibm ibm public license( version| v)?( 1 0)?
cddl-1.1 9 common common development and distribution license( version| v)? 1 1
cddl-1.1 9 cddl cddl( version| v)? 1 1
cddl-1.0 9 common common development and distribution license( version| v)? 1 0
cddl-1.0 9 cddl cddl( version| v)? 1 0
cddl 7 common common development and distribution license
bsd-4-clause 9 bsd bsd 4 clause( license)?|4 clause bsd( license)?
bsd-4-clause 8 bsd original bsd license|old bsd license
bsd-3-clause 9 bsd bsd 3 clause( license)?|3 clause bsd( license)?|three clause bsd( license)?
bsd-3-clause 8 bsd (new|modified|revised) bsd license
bsd-2-clause 9 bsd bsd 2 clause( license)?|2 clause bsd( license)?|two clause bsd( license)?
bsd-2-clause 8 bsd (simplified|freebsd) bsd license
bsd-1-clause 8 bsd bsd 1 clause( license)?|1 clause bsd( license)?
0bsd 8 0bsd 0bsd( license)?
0bsd 8 bsd zero clause bsd( license)?|bsd zero clause license
bsd 7 bsd bsd (style )?license|under (the |a )?bsd
mit-0 9 mit mit 0|mit no attribution
mit 9 mit (released|licensed|distributed|available|provided|published) under (the )?(terms of )?(the )?mit license
mit 8 mit (the )?mit license|mit licensed|license mit
mit 7 expat expat license
x11 7 x11 x11 license|mit x11
isc 8 isc isc license
zlib 8 zlib zlib( libpng)? license
libpng 7 libpng libpng license( version 2)?
boost-1.0 8 boost boost software license
boost-1.0 8 bsl bsl 1 0
unlicense 8 unlicense (the )?unlicense( org)?
wtfpl 8 wtfpl wtfpl( version 2)?
beerware 7 beerware beerware( license)?
artistic-2.0 9 artistic artistic license( version| v)? 2 0
artistic-1.0 9 artistic artistic license( version| v)? 1 0
artistic 7 artistic (the )?artistic license
clarified-artistic 7 artistic clarified artistic license
psf 8 python python software foundation license( version 2)?
cnri-python 7 cnri cnri( open source)? license( agreement)?
php-3.01 8 php php license( version| v)? 3 01
php-3.0 8 php php license( version| v)? 3 0
php 6 php (the )?php license
ruby 7 ruby (the )?ruby license|ruby s license
openssl 7 openssl openssl license
ofl-1.1 9 sil sil open font license( version| v)? 1 1
ofl-1.0 9 sil sil open font license( version| v)? 1 0
ofl 7 font open font license
eupl-1.2 9 eupl eupl( version| v)? 1 2
eupl-1.1 9 eupl eupl( version| v)? 1 1
eupl-1.0 9 eupl eupl( version| v)? 1 0
eupl 7 european european union public licen[cs]e
ms-pl 8 microsoft microsoft public license
ms-pl 8 ms ms pl
ms-rl 8 microsoft microsoft reciprocal license
ms-rl 8 ms ms rl
qpl-1.0 8 q (the )?q public license( version| v)?( 1 0)?
sleepycat 8 sleepycat sleepycat license
zpl-2.1 8 zope zope public license( version| v)? 2 1
zpl-2.0 8 zope zope public license( version| v)? 2 0
zpl 7 zope zope public license
w3c 7 w3c w3c software( notice and| and document notice and)? license
odbl-1.0 9 database open (data commons open )?database license( version| v)?( 1 0)?
odbl-1.0 8 odbl odbl( 1 0)?
odc-by-1.0 8 commons open data commons attribution license( version| v)?( 1 0)?
pddl-1.0 8 commons open data commons public domain dedication and license( version| v)?( 1 0)?
pddl-1.0 7 pddl pddl( 1 0)?
cecill-2.1 8 cecill cecill( version| v)? 2 1
cecill-b 8 cecill cecill b
cecill-c 8 cecill cecill c
cecill 7 cecill cecill( license)?
osl-3.0 8 open open software license( version| v)? 3 0
osl 7 open open software license
afl-3.0 8 academic academic free license( version| v)? 3 0
afl-2.1 8 academic academic free license( version| v)? 2 1
afl 7 academic academic free license
ecl-2.0 8 educational educational community license( version| v)? 2 0
ecl 7 educational educational community license
busl-1.1 8 business business source license( version| v)?( 1 1)?
sspl-1.0 8 server server side public license( version| v)?( 1)?
sspl-1.0 8 sspl sspl( version| v)?( 1)?
elastic-2.0 8 elastic elastic license( version| v)?( 2 0)?
commons-clause 8 commons commons clause( license)?( condition)?
polyform-nc-1.0 8 polyform polyform noncommercial license( 1 0 0)?
polyform-sb-1.0 8 polyform polyform small business license( 1 0 0)?
polyform 6 polyform polyform( project)? license
mulan-psl-2.0 8 mulan mulan (permissive software license|psl)( version| v)? 2
mulan-psl 7 mulan mulan (permissive software license|psl)
ncsa 8 ncsa (university of illinois )?ncsa( open source)? license
upl-1.0 8 universal universal permissive license( version| v)?( 1 0)?
apsl-2.0 8 apple apple public source license( version| v)? 2 0
apsl 7 apple apple public source license
rpsl-1.0 8 realnetworks realnetworks public source license
rpl-1.5 8 reciprocal reciprocal public license( version| v)?( 1 [15])?
sissl 8 sun sun industry standards source license
spl-1.0 8 sun sun public license( version| v)?( 1 0)?
lppl-1.3c 8 latex latex project public license( version| v)?( 1 [0-3][ac]?)?
intel 7 intel intel open source license
nasa-1.3 8 nasa nasa open source agreement( version| v)?( 1 3)?
lucent-1.02 8 lucent lucent public license( version| v)?( 1 0[02]?)?
nokia 8 nokia nokia open source license
watcom-1.0 8 watcom sybase open watcom public license
ngpl 7 nethack nethack general public license
oclc-2.0 8 oclc oclc research public license
eiffel-2.0 7 eiffel eiffel forum license( version| v)?( [12])?
fair 7 fair (the )?fair license
vsl-1.0 7 vovida vovida software license
xnet 7 net x net( inc)? license
wxwindows 8 wxwindows wxwindows library licen[cs]e
info-zip 7 zip info zip license
bzip2 7 bzip2 bzip2( and libbzip2)? license
icu 7 icu icu license
postgresql 8 postgresql (the )?postgresql license
unicode 7 unicode unicode( data files and software)? license
blue-oak-1.0 8 oak blue oak model license( version)?( 1 0 0)?
hippocratic-2.1 7 hippocratic hippocratic license( version| v)?( [123] [0-9])?
open-government-3.0 8 government open government licen[cs]e( version| v)?( 3 0)?
etalab-2.0 7 etalab (etalab )?(open licence|licence ouverte)( *){0,2} etalab|etalab( open licence)?( 2 0)?
rail 7 rail/openrail (open rail|openrail|creativeml open ?rail m|rail) license
llama 7 llama llama( [23])?( [0-9])? community license( agreement)?
copyleft 4 copyleft copyleft( license)?
spdx 8 spdx spdx license identifier *( only| or later)?
copyright 4 copyright copyright( c)?( (19|20)[0-9][0-9]){1,6}( by)?( *){1,3} all rights reserved|copyright( c)? (19|20)[0-9][0-9]
public-domain 5 domain (the )?public domain
license-file 5 see see (the )?(accompanying |file |enclosed )?licen[cs]e( file| txt| md)?( for( more)?)? (details|information|terms)
license-notice 5 licensed (is |are )?licensed under( the)? terms of
license-notice 4 licensed licensed under
license-notice 3 license/licensed under (the|a|this) license|this work is licensed|terms of (the|this) license
license-mention 2 licence (open|free|public|software) licence
license-mention 2 license (open|free|public|software) license
"""


class Rule(NamedTuple):
    order: int
    base: bool
    label: str
    strength: float
    keyword: str
    pattern: str


def spaced(pattern: str) -> str:
    """The pattern over texts that have a space at both ends of every word, so that neighbouring matches share none."""
    return " (?:" + pattern.replace(" ?", "\0").replace("*)", "[^ ]+)").replace(" *", " [^ ]+").replace(" ", "  ").replace("\0", "(?:  )?") + ") "


def parsed(text: str = BASE, rules: str = RULES) -> list[Rule]:
    lines = [(True, line) for line in text.split("\n")] + [(False, line) for line in rules.split("\n")]
    out = []
    for base, line in lines:
        if line:
            label, strength, keyword, pattern = line.split(" ", 3)
            out.append(Rule(len(out), base, label, int(strength) / 10, keyword, spaced(pattern)))
    return out
