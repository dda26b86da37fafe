"""Fixed IRIs of the W3C vocabularies, and CURIE shrinking and expanding."""

from __future__ import annotations

RDF, RDFS, OWL, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
SKOS, DCT, SH, W3C = "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/terms/", "http://www.w3.org/ns/shacl#", "http://www.w3.org/"
TYPE, LABEL, SUBCLASS, SUBPROP, DOMAIN, RANGE, COMMENT, SEE_ALSO, DEFINED_BY = RDF + "type", RDFS + "label", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range", RDFS + "comment", RDFS + "seeAlso", RDFS + "isDefinedBy"
PREF_LABEL, DEFINITION, CLOSE_MATCH, TITLE = SKOS + "prefLabel", SKOS + "definition", SKOS + "closeMatch", DCT + "title"
CLASS, ONTOLOGY, OBJ_PROP, DATA_PROP, ANN_PROP, RDF_PROP, RDFS_CLASS, RESTRICTION = OWL + "Class", OWL + "Ontology", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "AnnotationProperty", RDF + "Property", RDFS + "Class", OWL + "Restriction"
EQUIV_CLASS, EQUIV_PROP, DISJOINT, INVERSE, SAME, DIFFERENT, DEPRECATED, IMPORTS, VERSION_IRI, VERSION_INFO, NOTHING = OWL + "equivalentClass", OWL + "equivalentProperty", OWL + "disjointWith", OWL + "inverseOf", OWL + "sameAs", OWL + "differentFrom", OWL + "deprecated", OWL + "imports", OWL + "versionIRI", OWL + "versionInfo", OWL + "Nothing"
GRAPH = "http://example.org/quality#Graph"

# Types that need no declaration.
BUILTIN_TYPES = [
    OWL + "Thing",
    OWL + "Nothing",
    RDFS + "Resource",
    OWL + "Class",
    RDFS + "Class",
    OWL + "Restriction",
    RDFS + "Datatype",
    OWL + "NamedIndividual",
    OWL + "Ontology",
    OWL + "ObjectProperty",
    OWL + "DatatypeProperty",
    OWL + "AnnotationProperty",
    RDF + "Property",
    OWL + "FunctionalProperty",
    OWL + "InverseFunctionalProperty",
    OWL + "TransitiveProperty",
    OWL + "SymmetricProperty",
    OWL + "AsymmetricProperty",
    OWL + "ReflexiveProperty",
    OWL + "IrreflexiveProperty",
    OWL + "AllDisjointClasses",
    OWL + "AllDisjointProperties",
    OWL + "AllDifferent",
    OWL + "NegativePropertyAssertion",
    OWL + "Axiom",
]

WELL_KNOWN = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS}


def shrink(iri: str, prefixes: dict[str, str]) -> str:
    """The CURIE of an IRI: longest namespace first, a named prefix before the empty one, then the order given."""
    fits = [(len(ns), prefix != "", -k, prefix, ns) for k, (prefix, ns) in enumerate(prefixes.items()) if iri.startswith(ns) and len(iri) > len(ns)]
    return f"{max(fits)[3]}:{iri[max(fits)[0]:]}" if fits else iri


def expand(curie: str, prefixes: dict[str, str]) -> str:
    prefix, colon, local = curie.partition(":")
    return prefixes[prefix] + local if colon and prefix in prefixes else curie


def local_name(iri: str) -> str:
    return iri[max(iri.rfind("#"), iri.rfind("/")) + 1 :]


def namespace(iri: str) -> str:
    return iri[: max(iri.rfind("#"), iri.rfind("/")) + 1]


def primary_prefix(prefixes: dict[str, str]) -> str | None:
    return next((p for p, ns in prefixes.items() if ns not in WELL_KNOWN.values()), None)
