"""Rule packs over triples. Fixed by their specifications: RDF 1.1 Semantics (W3C, entailment patterns rdf1 and rdfs1 to rdfs13, axiomatic triples) and
H. J. ter Horst, "Completeness, decidability and complexity of entailment for RDF Schema and a semantic extension involving the OWL vocabulary" (2005; pD*).
Variables: a, b resources; p, q, r properties; c, d, e classes; l, m, n lists.
"""

_PREFIXES = """@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
"""
_COMMON = _PREFIXES + """
{ ?a ?p ?b } => { ?p rdf:type rdf:Property } .
{ ?p rdfs:domain ?c . ?a ?p ?b } => { ?a rdf:type ?c } .
{ ?p rdfs:range ?c . ?a ?p ?b } => { ?b rdf:type ?c } .
{ ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r } => { ?p rdfs:subPropertyOf ?r } .
{ ?p rdf:type rdf:Property } => { ?p rdfs:subPropertyOf ?p } .
{ ?a ?p ?b . ?p rdfs:subPropertyOf ?q } => { ?a ?q ?b } .
{ ?c rdf:type rdfs:Class } => { ?c rdfs:subClassOf rdfs:Resource . ?c rdfs:subClassOf ?c } .
{ ?c rdfs:subClassOf ?d . ?a rdf:type ?c } => { ?a rdf:type ?d } .
{ ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e } => { ?c rdfs:subClassOf ?e } .
{ ?p rdf:type rdfs:ContainerMembershipProperty } => { ?p rdfs:subPropertyOf rdfs:member } .
{ ?c rdf:type rdfs:Datatype } => { ?c rdfs:subClassOf rdfs:Literal } .
"""
#: RDF and RDFS entailment.
RDFS = _COMMON + """
{ ?a ?p ?b } => { ?a rdf:type rdfs:Resource . ?b rdf:type rdfs:Resource } .
"""
#: Support rules for what the translation of axioms to rules (owl/axioms.py) leaves out.
SUPPORT = _PREFIXES + """
{ ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e } => { ?c rdfs:subClassOf ?e } .
{ ?c owl:equivalentClass ?d } => { ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c } .
{ ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c } => { ?c owl:equivalentClass ?d } .
{ ?c owl:disjointWith ?d . ?a a ?c . ?b a ?d } => { ?a owl:differentFrom ?b } .
{ ?p owl:inverseOf ?q . ?p a owl:InverseFunctionalProperty } => { ?q a owl:FunctionalProperty } .
{ ?p owl:inverseOf ?q . ?p a owl:FunctionalProperty } => { ?q a owl:InverseFunctionalProperty } .
{ ?c owl:oneOf ?l . ?l rdf:first ?a . ?l rdf:rest rdf:nil . ?p rdfs:domain ?c } => { ?p a owl:InverseFunctionalProperty } .
{ ?c owl:oneOf ?l . ?l rdf:first ?a . ?l rdf:rest rdf:nil . ?p rdfs:range ?c } => { ?p a owl:FunctionalProperty } .
{ ?a owl:differentFrom ?b } => { ?b owl:differentFrom ?a } .
{ ?c owl:complementOf ?d } => { ?d owl:complementOf ?c } .
{ ?c owl:disjointWith ?d } => { ?d owl:disjointWith ?c } .
"""
#: Axiomatic triples of pD*.
PD_AXIOMS = _PREFIXES + """
rdf:type a rdf:Property . rdf:first a rdf:Property ; rdfs:domain rdf:List . rdf:rest a rdf:Property ; rdfs:domain rdf:List ; rdfs:range rdf:List .
rdf:value a rdf:Property . rdf:nil a rdf:List . rdfs:isDefinedBy rdfs:subPropertyOf rdfs:seeAlso .
rdf:Alt rdfs:subClassOf rdfs:Container . rdf:Bag rdfs:subClassOf rdfs:Container . rdf:Seq rdfs:subClassOf rdfs:Container .
rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property . rdf:XMLLiteral rdfs:subClassOf rdfs:Literal ; a rdfs:Datatype . rdfs:Datatype rdfs:subClassOf rdfs:Class .
owl:FunctionalProperty rdfs:subClassOf rdf:Property . owl:InverseFunctionalProperty rdfs:subClassOf rdf:Property .
owl:SymmetricProperty rdfs:subClassOf rdf:Property . owl:TransitiveProperty rdfs:subClassOf rdf:Property . owl:sameAs a rdf:Property .
owl:inverseOf a rdf:Property ; rdfs:domain rdf:Property ; rdfs:range rdf:Property . owl:equivalentClass a rdf:Property ; rdfs:domain owl:Class ; rdfs:range owl:Class .
owl:equivalentProperty a rdf:Property ; rdfs:domain rdf:Property ; rdfs:range rdf:Property . owl:onProperty rdfs:domain owl:Restriction ; rdfs:range rdf:Property .
owl:hasValue rdfs:domain owl:Restriction . owl:someValuesFrom rdfs:domain owl:Restriction ; rdfs:range rdfs:Class . owl:allValuesFrom rdfs:domain owl:Restriction ; rdfs:range rdfs:Class .
owl:differentFrom a rdf:Property , owl:SymmetricProperty . owl:disjointWith rdfs:domain owl:Class ; rdfs:range owl:Class ; a owl:SymmetricProperty . owl:complementOf a owl:SymmetricProperty .
"""
#: Classes given by lists, members of lists, and sub-classes and sub-properties from equality.
LISTS = _PREFIXES + """
{ ?l rdf:first ?a } => { ?a <urn:list#in> ?l } .
{ ?l rdf:rest ?m . ?a <urn:list#in> ?m } => { ?a <urn:list#in> ?l } .
{ ?c owl:oneOf ?l . ?a <urn:list#in> ?l } => { ?a a ?c } .
{ ?c owl:unionOf ?l . ?d <urn:list#in> ?l . ?a a ?d } => { ?a a ?c } .
{ ?c owl:intersectionOf ?l . ?d <urn:list#in> ?l } => { ?c rdfs:subClassOf ?d } .
{ ?c owl:intersectionOf ?l . ?a <urn:list#inAllOf> ?l } => { ?a a ?c } .
{ ?l rdf:first ?d . ?l rdf:rest rdf:nil . ?a a ?d } => { ?a <urn:list#inAllOf> ?l } .
{ ?l rdf:first ?d . ?l rdf:rest ?m . ?a a ?d . ?a <urn:list#inAllOf> ?m } => { ?a <urn:list#inAllOf> ?l } .
{ ?l rdf:first ?d . ?a a ?d } => { ?a <urn:list#inSomeOf> ?l } .
{ ?l rdf:rest ?m . ?a <urn:list#inSomeOf> ?m } => { ?a <urn:list#inSomeOf> ?l } .
{ ?l rdf:first ?a } => { ?l a rdf:List } .
{ ?l rdf:rest ?m } => { ?l a rdf:List } .
{ ?l a rdf:List } => { ?l <urn:list#subListOf> ?l } .
{ ?l rdf:rest ?m . ?n <urn:list#subListOf> ?m } => { ?n <urn:list#subListOf> ?l } .
{ ?c a owl:Class . ?c owl:sameAs ?d } => { ?c rdfs:subClassOf ?d } .
{ ?p a rdf:Property . ?p owl:sameAs ?q } => { ?p rdfs:subPropertyOf ?q } .
"""
#: Property kinds, equality, restrictions and lists beyond RDFS (the pD* fragment, which doesn't type all nodes as resources).
PD = _COMMON + SUPPORT + PD_AXIOMS + """
{ ?p a owl:FunctionalProperty . ?a ?p ?b . ?a ?p ?c . ?b <http://www.w3.org/2000/10/swap/log#notEqualTo> ?c } => { ?b owl:sameAs ?c } .
{ ?p a owl:InverseFunctionalProperty . ?a ?p ?c . ?b ?p ?c . ?a <http://www.w3.org/2000/10/swap/log#notEqualTo> ?b } => { ?a owl:sameAs ?b } .
{ ?p a owl:SymmetricProperty . ?a ?p ?b } => { ?b ?p ?a } .
{ ?p a owl:TransitiveProperty . ?a ?p ?b . ?b ?p ?c } => { ?a ?p ?c } .
{ ?a owl:sameAs ?b } => { ?b owl:sameAs ?a } .
{ ?a owl:sameAs ?b . ?b owl:sameAs ?c } => { ?a owl:sameAs ?c } .
{ ?a owl:sameAs ?b . ?a ?p ?c } => { ?b ?p ?c } .
{ ?a owl:sameAs ?b . ?c ?p ?a } => { ?c ?p ?b } .
{ ?p owl:inverseOf ?q . ?a ?p ?b } => { ?b ?q ?a } .
{ ?p owl:inverseOf ?q . ?a ?q ?b } => { ?b ?p ?a } .
{ ?c owl:equivalentClass ?d } => { ?d owl:equivalentClass ?c . ?c rdfs:subClassOf ?d } .
{ ?p owl:equivalentProperty ?q } => { ?q owl:equivalentProperty ?p . ?p rdfs:subPropertyOf ?q } .
{ ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p } => { ?p owl:equivalentProperty ?q } .
{ ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?a ?p ?v } => { ?a a ?r } .
{ ?r owl:hasValue ?v . ?r owl:onProperty ?p . ?a a ?r } => { ?a ?p ?v } .
{ ?r owl:someValuesFrom ?c . ?r owl:onProperty ?p . ?a ?p ?b . ?b a ?c } => { ?a a ?r } .
{ ?r owl:allValuesFrom ?c . ?r owl:onProperty ?p . ?a a ?r . ?a ?p ?b } => { ?b a ?c } .
""" + LISTS
#: RDF and RDFS entailment of schema and container properties, with the axiomatic triples of the RDF and RDFS vocabularies.
RDF_AXIOMS = _PREFIXES + """@prefix str: <http://www.w3.org/2000/10/swap/string#> .
rdf:type a rdf:Property . rdf:subject a rdf:Property . rdf:predicate a rdf:Property . rdf:object a rdf:Property . rdf:first a rdf:Property . rdf:rest a rdf:Property .
rdf:value a rdf:Property . rdf:_1 a rdf:Property . rdf:nil a rdf:List .
rdf:type rdfs:domain rdfs:Resource ; rdfs:range rdfs:Class . rdfs:domain rdfs:domain rdf:Property ; rdfs:range rdfs:Class . rdfs:range rdfs:domain rdf:Property ; rdfs:range rdfs:Class .
rdfs:subPropertyOf rdfs:domain rdf:Property ; rdfs:range rdf:Property . rdfs:subClassOf rdfs:domain rdfs:Class ; rdfs:range rdfs:Class .
rdf:subject rdfs:domain rdf:Statement ; rdfs:range rdfs:Resource . rdf:predicate rdfs:domain rdf:Statement ; rdfs:range rdfs:Resource . rdf:object rdfs:domain rdf:Statement ; rdfs:range rdfs:Resource .
rdfs:member rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource . rdf:first rdfs:domain rdf:List ; rdfs:range rdfs:Resource . rdf:rest rdfs:domain rdf:List ; rdfs:range rdf:List .
rdfs:seeAlso rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource . rdfs:isDefinedBy rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource ; rdfs:subPropertyOf rdfs:seeAlso .
rdfs:comment rdfs:domain rdfs:Resource ; rdfs:range rdfs:Literal . rdfs:label rdfs:domain rdfs:Resource ; rdfs:range rdfs:Literal . rdf:value rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource .
rdf:Alt rdfs:subClassOf rdfs:Container . rdf:Bag rdfs:subClassOf rdfs:Container . rdf:Seq rdfs:subClassOf rdfs:Container . rdfs:ContainerMembershipProperty rdfs:subClassOf rdf:Property .
rdf:_1 a rdfs:ContainerMembershipProperty ; rdfs:domain rdfs:Resource ; rdfs:range rdfs:Resource . rdf:XMLLiteral a rdfs:Datatype ; rdfs:subClassOf rdfs:Literal . rdfs:Datatype rdfs:subClassOf rdfs:Class .
{ ?a ?p ?b } => { ?p a rdf:Property } .
{ ?p rdfs:range ?c . ?c rdfs:subClassOf ?d } => { ?p rdfs:range ?d } .
{ ?p rdfs:domain ?c . ?c rdfs:subClassOf ?d } => { ?p rdfs:domain ?d } .
{ ?c a rdfs:Class } => { ?c rdfs:subClassOf rdfs:Resource } .
{ ?a ?p ?b . ?p str:matches "^http://www.w3.org/1999/02/22-rdf-syntax-ns#_[0-9]+$" } => { ?p a rdfs:ContainerMembershipProperty } .
"""
#: Denials: what must not hold.
INCONSISTENT = _PREFIXES + """
{ ?a owl:sameAs ?b . ?a owl:differentFrom ?b } => false .
{ ?a a owl:Nothing } => false .
"""
