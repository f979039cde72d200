"""Fixed values of the licence scan: sentence patterns and licence rules.

The wording is that of the licences' own texts and of the usual one-line notices.
"""

# Fixed values.  (sentence identifier, regular expression over a normalised sentence); the first
# that is found names the sentence.  Sentences are lower case, punctuation inside them is a space,
# except dots and plus signs.
SENTENCES = [
    ("SpdxId", r"spdx license identifier"),
    ("Agpl3Later", r"gnu affero general public license.*version 3.*any later version"),
    ("Agpl3", r"gnu affero general public license.*version 3"),
    ("Lgpl21Later", r"gnu lesser general public license.*version 2\.1.*any later version"),
    ("Lgpl21", r"gnu lesser general public license.*version 2\.1"),
    ("Lgpl3Later", r"gnu lesser general public license.*version 3.*any later version"),
    ("Lgpl3", r"gnu lesser general public license.*version 3"),
    ("Gpl3Later", r"gnu general public license.*version 3.*any later version"),
    ("Gpl3", r"gnu general public license.*version 3"),
    ("Gpl2Later", r"gnu general public license.*version 2.*any later version"),
    ("Gpl2", r"gnu general public license.*version 2"),
    ("GplSeeCopy", r"you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("GplNoWarranty", r"distributed in the hope that it will be useful.*without any warranty"),
    ("GplDetails", r"see the gnu (lesser |affero )?general public license for more details"),
    ("Apache2", r"licensed under the apache license version 2\.0"),
    ("ApacheCompliance", r"you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing.*as is basis"),
    ("ApacheLimits", r"see the license for the specific language governing permissions and limitations"),
    ("MitNamed", r"(released|licensed|available|distributed) under the (terms of the )?mit license"),
    ("MitTitle", r"^(the )?mit license"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable"),
    ("IscGrant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties"),
    ("Bsd3Named", r"licensed under the (bsd 3 clause|3 clause bsd|new bsd) license"),
    ("Bsd2Named", r"licensed under the (bsd 2 clause|2 clause bsd|simplified bsd) license"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"neither the names? of .*may be used to endorse or promote products"),
    ("BsdAsIs", r"this software is provided by .*as is and any express or implied warranties"),
    ("BsdLiability", r"in no event shall .*be liable for any direct indirect incidental special"),
    ("Mpl2", r"mozilla public license v(ersion)?\.? ?2\.0"),
    ("MplCopy", r"if a copy of the mpl was not distributed with this file"),
    ("CcZero", r"(cc0|creative commons zero)"),
    ("CcByNcNd", r"licensed under (a )?(cc|creative commons) (by nc nd|attribution noncommercial noderivatives)"),
    ("CcByNcSa", r"licensed under (a )?(cc|creative commons) (by nc sa|attribution noncommercial sharealike)"),
    ("CcByNc", r"licensed under (a )?(cc|creative commons) (by nc|attribution noncommercial)"),
    ("CcBySa", r"licensed under (a )?(cc|creative commons) (by sa|attribution sharealike)"),
    ("CcByNd", r"licensed under (a )?(cc|creative commons) (by nd|attribution noderivatives)"),
    ("CcBy", r"licensed under (a )?(cc|creative commons) (by|attribution)"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(placed|released|dedicated) (in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (c )?(19|20)[0-9][0-9]"),
    ("OtherLicense", r"(licensed|released|distributed) under"),
]

# Fixed values.  (licence, sentence identifiers in order).  Rules are tried in this order; the
# sentences that a rule explains are taken out before the next rule is tried.
RULES = [
    ("Apache-2.0", ["Apache2", "ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheLimits"]),
    ("Apache-2.0", ["Apache2", "ApacheCompliance", "ApacheObtain"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs", "BsdLiability"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitTitle", "MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("MIT-style", ["MitGrant", "MitAsIs"]),
    ("ISC", ["IscGrant", "IscAsIs"]),
    ("AGPL-3.0-or-later", ["Agpl3Later", "GplNoWarranty", "GplDetails", "GplSeeCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplNoWarranty", "GplDetails", "GplSeeCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplNoWarranty", "GplDetails", "GplSeeCopy"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later", "GplNoWarranty", "GplDetails", "GplSeeCopy"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later", "GplNoWarranty", "GplDetails", "GplSeeCopy"]),
    ("MPL-2.0", ["Mpl2", "MplCopy"]),
    ("Apache-2.0", ["Apache2"]),
    ("MIT", ["MitNamed"]),
    ("BSD-3-Clause", ["Bsd3Named"]),
    ("BSD-2-Clause", ["Bsd2Named"]),
    ("AGPL-3.0-or-later", ["Agpl3Later"]),
    ("AGPL-3.0-only", ["Agpl3"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-3.0-only", ["Gpl3"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("GPL-2.0-only", ["Gpl2"]),
    ("LGPL-3.0-or-later", ["Lgpl3Later"]),
    ("LGPL-3.0-only", ["Lgpl3"]),
    ("LGPL-2.1-or-later", ["Lgpl21Later"]),
    ("LGPL-2.1-only", ["Lgpl21"]),
    ("MPL-2.0", ["Mpl2"]),
    ("CC0-1.0", ["CcZero"]),
    ("CC-BY-NC-ND", ["CcByNcNd"]),
    ("CC-BY-NC-SA", ["CcByNcSa"]),
    ("CC-BY-NC", ["CcByNc"]),
    ("CC-BY-SA", ["CcBySa"]),
    ("CC-BY-ND", ["CcByNd"]),
    ("CC-BY", ["CcBy"]),
    ("Unlicense", ["Unlicense"]),
    ("Public-domain", ["PublicDomain"]),
    ("BSD-style", ["BsdGrant"]),
    ("MIT-style", ["MitGrant"]),
    ("Proprietary", ["Copyright", "AllRights"]),
    ("See-license", ["SpdxId"]),
    ("Unknown-license", ["OtherLicense"]),
]

# Each sentence pattern contains one of these words; texts without them are not read further.
TRIGGERS = ["licen", "copyright", "permission", "redistribution", "warrant", "provided", "public", "rights reserved",
            "received a copy", "mozilla", "mpl", "cc0", "creative commons", "under", "unless required", "obtain",
            "shall", "neither"]
